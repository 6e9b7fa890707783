"""Personal data: expressions propose spans, checksums confirm them, context words adjust the score.

DataFrame functions only. Positions come from what stands between the matches: the text is split by the
same expression that extracts them, and lengths are summed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
MORE = ("iban", "ssn", "national_phone")
#: Where a match may begin: after the match before it, or where no such character precedes. Inside a
#: longer run a match that fails from the run's start fails from every other place, so nothing is lost.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_NATIONAL = r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
#: Score of a proposed and confirmed span, and what a context word within reach adds; kept from 0.5 on.
ACCEPT, BEFORE, AFTER = 0.5, 48, 24
SCORES = {"email": (0.9, 0.1, r"\b(?:e-?)?mail\b|\bcontact\b|\bwrite\b"), "ip": (0.6, 0.2, r"\bip\b|\bhost\b|\bserver\b|\baddress\b"), "card": (0.8, 0.2, r"\bcards?\b|\bvisa\b|\bmaster(?:card)?\b|\bamex\b|\bcredit\b|\bpayment\b"), "phone": (0.7, 0.2, r"\b(?:tele)?phone\b|\btel\b|\bcall\b|\bfax\b|\bmobile\b"), "iban": (0.8, 0.2, r"\biban\b|\baccount\b|\bbank\b|\bkonto\b|\bcompte\b|\bcuenta\b"), "ssn": (0.3, 0.4, r"\bssn\b|\bsocial security\b"), "national_phone": (0.3, 0.4, r"\b(?:tele)?phone\b|\btel\b|\bcall\b|\bfax\b|\bmobile\b")}


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(lengths: Column) -> Column:
    """Inclusive running sums of an array: whole blocks first, then the rest of the last block."""
    block = 64
    plus = lambda a, b: a + b
    zero = F.lit(0).cast("long")
    sums = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: F.aggregate(F.slice(x, b * block + 1, F.lit(block)), zero, plus))
    at = lambda x, s: F.transform(x, lambda _, i: F.aggregate(F.slice(s, F.lit(1), F.floor(i / block).cast("int")), zero, plus) + F.aggregate(F.slice(x, F.floor(i / block).cast("int") * block + 1, i % block + 1), zero, plus))
    return let(lengths, lambda x: F.when(F.size(x) == 0, F.array().cast("array<bigint>")).otherwise(let(sums(x), lambda s: at(x, s))))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: array of (start, end, found, before, after), in code points."""

    def placed(x: Column) -> Column:
        pieces, found = x["pieces"], x["found"]
        lengths = F.transform(found, lambda m, i: (F.length(m) + F.length(F.get(pieces, i))).cast("long"))
        one = lambda m, i, ends: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.get(ends, i).alias("end"), m.alias("found"), F.right(F.get(pieces, i), F.lit(BEFORE)).alias("before"), F.left(F.get(pieces, i + 1), F.lit(AFTER)).alias("after"))
        return let(running(lengths), lambda ends: F.transform(found, lambda m, i: one(m, i, ends)))

    both = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return let(both, placed)


def digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """The digits of a number satisfy the Luhn checksum."""
    turned = F.transform(F.split(F.reverse(number), "(?!^)(?!$)"), lambda d: d.cast("int"))
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.aggregate(F.transform(turned, lambda d, i: F.when(i % 2 == 1, doubled(d)).otherwise(d)), F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(iban: Column) -> Column:
    """The rearranged letters and digits leave 1 modulo 97."""
    plain = F.regexp_replace(iban, r"\x20", "")
    moved = F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, "(?!^)(?!$)"), F.lit(0), lambda a, c: (a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97) == 1


_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"
_KINDS = {
    "email": (_EMAIL, lambda t: t.contains("@"), lambda m: F.lit(True)),
    "ip": (_IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")),
    "card": (_CARD, lambda t: t.rlike(r"[0-9][\x20-]?[0-9]"), lambda m: let(digits(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))),
    "phone": (_PHONE, lambda t: t.contains("+"), lambda m: F.length(digits(m)).between(9, 15)),
    "iban": (_IBAN, lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}[\x20A-Z0-9]"), mod97),
    "ssn": (_SSN, lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"), lambda m: ~m.rlike("^(?:000|666|9)")),
    "national_phone": (_NATIONAL, lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), lambda m: F.lit(True)),
}


def _spans(text: Column, kind: str) -> Column:
    pattern, may, valid = _KINDS[kind]
    base, more, words = SCORES[kind]
    found = F.filter(matches(text, pattern), lambda x: valid(x["found"]))
    score = lambda x: F.lit(base) + F.when(F.lower(x["before"]).rlike(words) | F.lower(x["after"]).rlike(words), F.lit(more)).otherwise(F.lit(0.0))
    scored = F.transform(found, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), score(x).alias("score")))
    return F.when(may(text), F.filter(scored, lambda x: x["score"] >= ACCEPT)).otherwise(F.array().cast("array<struct<kind:string,start:bigint,end:bigint,score:double>>"))


def find_personal_data(docs: DataFrame, text_col: str = "text", out_col: str = "personal_data") -> DataFrame:
    """docs with out_col: array of (kind, start, end, score) by kind and start; code points, end exclusive.

    The four base kinds are kept at any context; the others need their checksum or a context word. Null
    and empty texts have an empty array; repeated rows and ties get equal spans; empty docs give no rows. A
    column named out_col is replaced, all others are kept.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumn(out_col, F.concat(*[_spans(text, k) for k in (*BASE, *MORE)]))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
