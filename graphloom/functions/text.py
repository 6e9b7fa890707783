"""Text expressions: normalisation, tokens, lines, numbers, word-boundary containment."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The token pattern of the lexical index, as Java, RE2 and Python all read it.
TOKEN = "[a-z0-9]+(?:['’-][a-z0-9]+)*|[\\x{3400}-\\x{9fff}]|[\\p{L}\\p{Nl}\\p{No}]+"
#: Characters that NFKC leaves as they are wherever they stand together: texts of these alone stay in the JVM.
STABLE = "\\x00-\\x7FÀ-ıĴ-ľŁ-ňŊ-žЀ-ӿ一-鿿"
# What is read as a number, what is refused, number words, numerals and the units after which numerals count.
STEP_PREFIX = "^\\s*(?:[0-9]+\\s*[.)、:]|第[零〇一二两三四五六七八九十百千万0-9]+步[：:]?)\\s*"
NUMBER = "(?<![A-Za-z0-9_.])[+-]?[0-9]+(?:\\.[0-9]+)?(?:/[0-9]+(?:\\.[0-9]+)?)?"
UNSUPPORTED_NUMBER = "(?<![A-Za-z0-9_.])(?:[+-]?(?:[0-9]+(?:\\.[0-9]+)?|\\.[0-9]+)[eE][+-]?[0-9]|[0-9]+(?:[,_][0-9]+)+|\\.[0-9])"
NUMBER_WORDS = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20", "half": "0.5"}
NUMERALS, NUMERAL_DIGITS = "零〇一二两三四五六七八九", "001223456789"
NUMERAL_UNITS = "分钟|小时|秒钟|秒|克|千克|毫升|升|度|℃|℉|个|枚|片|块|瓣|颗|只|根|份|勺|汤匙|茶匙|杯|小撮"
# Amounts (mixed and vulgar fractions too), durations and temperatures.
_AMOUNT = "(?:[0-9]+\\s+[0-9]+/[0-9]+|[0-9]+/[0-9]+|[0-9]+(?:\\.[0-9]+)?|[¼½¾])"
_RANGE = f"{_AMOUNT}(?:\\s*(?:-|–|—|to)\\s*{_AMOUNT})?"
_FREE, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
DURATION = f"(?i){_FREE}(?:{_RANGE}\\s*(?:seconds?|secs?|minutes?|mins?|hours?|hrs?)|half\\s+(?:an?\\s+)?hour|an?\\s+(?:minute|hour)|overnight){_END}"
TEMPERATURE = f"(?i){_FREE}[-+]?{_RANGE}\\s*(?:°\\s*[CF]|degrees?\\s*(?:Celsius|Fahrenheit|[CF])|Celsius|Fahrenheit|[CF]){_END}"


def squeeze(text: Column) -> Column:
    """White space runs become one blank; none at the edges."""
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def key(text: Column) -> Column:
    """Lower case; white space and hyphens of any kind become one blank; trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), "(?U)[\\s\\-‐‑–—]+", " "))


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode NFKC, which no built-in function offers; null stays null."""
    return text.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


def compatible(text: Column) -> Column:
    """NFKC; only texts with a character that it could change leave the JVM."""
    return F.coalesce(nfkc(F.when(text.rlike(f"[^{STABLE}]"), text)), text)


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


def name(text: Column) -> Column:
    return key(nfkc(text))


def term(text: Column) -> Column:
    """NFKC, case-folded, anything but letters and digits a blank."""
    return F.trim(F.regexp_replace(casefold(nfkc(text)), "[^\\p{L}\\p{N}]+", " "))


def tokens(text: Column) -> Column:
    """Lexical tokens of the NFKC text: Latin words with inner apostrophes or hyphens, single ideographs, other letter runs."""
    return F.regexp_extract_all(F.lower(compatible(text)), F.lit(TOKEN), F.lit(0))


def lines(text: Column) -> Column:
    """Lines without surrounding white space, empty ones left out."""
    bare = F.transform(F.split(text, "\\R"), lambda x: F.regexp_replace(x, "(?U)^\\s+|\\s+$", ""))
    return F.filter(bare, lambda x: x != "")


def numbers(text: Column) -> Column:
    """Distinct numeric literals in order of kind and place: digits (signed, decimal or a fraction), number words, numerals
    before a unit. A step's leading number is none; null for notation that is refused rather than read."""
    text = F.regexp_replace(text, STEP_PREFIX, "")
    plain = lambda n: F.when(n.contains("."), F.regexp_replace(F.regexp_replace(n, "0+$", ""), "\\.$", "")).otherwise(n)
    bare = lambda n: F.regexp_replace(F.regexp_replace(plain(n), "^\\+", ""), "^(-?)0+(?=[0-9])", "$1")
    found = F.transform(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), lambda n: F.array_join(F.transform(F.split(n, "/"), bare), "/"))
    known = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    words = F.transform(F.regexp_extract_all(text, F.lit(f"(?i)\\b({'|'.join(NUMBER_WORDS)})\\b"), F.lit(1)), lambda w: F.element_at(known, F.lower(w)))
    numerals = F.regexp_extract_all(text, F.lit(f"([{NUMERALS}十百千万半]+)(?=\\s*(?:{NUMERAL_UNITS}))"), F.lit(1))
    values = F.filter(F.transform(numerals, lambda n: bare(chinese_number(n).cast("decimal(38,4)").cast("string"))), lambda v: v.isNotNull())
    return F.when(~text.rlike(UNSUPPORTED_NUMBER), F.array_distinct(F.concat(found, words, values)))


def contains_alias(text: Column, alias: str) -> Column:
    """An ideographic alias is contained anywhere, any other one only between word boundaries."""
    if any("一" <= c <= "鿿" for c in alias):
        return text.contains(alias)
    import re

    return F.lower(text).rlike(f"(?<!\\w){re.escape(alias.lower())}(?!\\w)")


def lexical_query(text: Column) -> Column:
    """The quoted passage if there is one, else the text itself."""
    quoted = F.regexp_extract(text, "[\"“]([^\"”]+)[\"”]", 1)
    return F.when(quoted != "", quoted).otherwise(text)


def url_valid(url: Column) -> Column:
    """http(s), with a host, without white space or credentials."""
    parts = lambda p: F.try_parse_url(url, F.lit(p))
    return F.coalesce(F.lower(parts("PROTOCOL")).isin("http", "https") & (F.length(parts("HOST")) > 0) & ~url.rlike("(?U)\\s") & parts("USERINFO").isNull(), F.lit(False))


def _section(text: Column) -> Column:
    """Value of a numeral below 10,000: each unit by the digit before it (one where there is none), and a last digit."""
    digit = lambda pattern: F.translate(F.regexp_extract(text, pattern, 1), NUMERALS, NUMERAL_DIGITS)
    total = F.lit(0.0)
    for sign, value in (("千", 1000.0), ("百", 100.0), ("十", 10.0)):
        before = digit(f"([{NUMERALS}]?){sign}")
        total = total + F.when(text.contains(sign), value * F.when(before.isin("", "0"), 1.0).otherwise(before.try_cast("double"))).otherwise(0.0)
    return total + F.coalesce(digit(f"([{NUMERALS}])$").try_cast("double"), F.lit(0.0))


def chinese_number(text: Column) -> Column:
    """Value of a numeral (digits, or 十 百 千 万 with digits, 半 alone as a half); null if it is none."""
    high, low = F.regexp_extract(text, "^(.*)万", 1), F.regexp_extract(text, "([^万]*)$", 1)
    thousands = F.when(text.contains("万"), F.greatest(_section(high), F.lit(1.0)) * 10_000.0).otherwise(0.0)
    value = F.when(text.rlike("[十百千万]"), thousands + _section(low)).otherwise(F.translate(text, NUMERALS, NUMERAL_DIGITS).try_cast("double"))
    return F.when(text == "半", 0.5).when(text.rlike("^[0-9]+$"), text.try_cast("double")).when(text.rlike(f"^[{NUMERALS}十百千万]+$"), value)


def minutes_limit(text: Column) -> Column:
    """The smallest time limit a question names, in minutes."""
    amount = lambda pattern, factor: F.transform(F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(1)), lambda n: n.try_cast("double") * factor)
    half = F.when(F.lower(text).rlike("half an hour|半小时|半个小时"), F.array(F.lit(30.0))).otherwise(F.array().cast("array<double>"))
    return F.array_min(F.concat(amount("([0-9]+(?:\\.[0-9]+)?)\\s*(?:minutes?|mins?|分钟)", 1.0), amount("([0-9]+(?:\\.[0-9]+)?)\\s*(?:hours?|hrs?|小时|个小时)", 60.0), half))


def key_folded(text: Column) -> Column:
    """The key of a text by case folding in place of lower case."""
    return F.trim(F.regexp_replace(casefold(text), "(?U)[\\s\\-‐‑–—]+", " "))


def query_terms(text: Column, most: int = 12) -> Column:
    """The first distinct words of a question, in lower case."""
    found = F.filter(F.split(F.lower(text), "(?U)[\\s,，。;；、?？!！]+"), lambda x: x != "")
    return F.slice(F.array_distinct(found), 1, most)


def title_and_steps(title: Column, steps: Column) -> Column:
    """The text that is indexed of a record: its title and its steps, a line each."""
    return F.concat_ws("\n", title, F.array_join(steps, "\n"))


def normalized_span(text: Column, needle: str) -> Column:
    """Struct (start, end) of the first place of a needle (case-folded, white space squeezed) in a text, in the raw text's code points."""
    squeezed = " ".join(needle.casefold().split())

    def span(text: str | None) -> tuple[int | None, int | None]:
        if text is None:
            return None, None
        folded, places, blank = [], [], True
        for i, c in enumerate(text):
            if c.isspace():
                if not blank:
                    folded.append(" ")
                    places.append(i)
                blank = True
            else:
                low = c.casefold()
                folded.append(low)
                places += [i] * len(low)
                blank = False
        at = "".join(folded).find(squeezed)
        return (None, None) if at < 0 else (places[at], places[at + len(squeezed) - 1] + 1)

    @F.pandas_udf("struct<start:int,end:int>")
    def find(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([span(t) for t in texts], columns=["start", "end"], dtype="Int32")

    return find(text)


def url_quoted(part: Column) -> Column:
    """Percent-encoded as a path segment: blanks as %20, unreserved characters and slashes as they are."""
    return F.regexp_replace(F.regexp_replace(F.url_encode(part), "\\+", "%20"), "%2F", "/")


def fenced_json(text: Column) -> Column:
    """The JSON inside a fence of three backticks, or the text itself."""
    inside = F.regexp_extract(text, "(?s)```(?:json)?\\s*(.*?)\\s*```", 1)
    return F.when(inside != "", inside).otherwise(F.trim(text))


def expanded_query(text: Column, aliases: dict[str, list[str]]) -> Column:
    """A question followed by the aliases of every name that it contains, in listed order."""
    more = [F.when(contains_alias(text, name), F.lit(" ".join(others))) for name, others in aliases.items()]
    return F.concat_ws(" ", text, *more)
