"""Quality rules as a short-circuit cascade: rules are ordered by rejections per cost, both taken from a sample.

DataFrame functions only. The order changes only what has to be evaluated, never a verdict.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, saved
from .pii import let

#: The sample: rows, bytes of text, files that it is taken from, seed; and bytes that a rule's timing works on.
SAMPLE_ROWS, SAMPLE_BYTES, SAMPLE_FILES, SEED, TIMED_BYTES = 200, 4 << 20, 64, 7, 1 << 20
#: Words of a repeated window.
WINDOW = 5
_SPACE = r"[\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"{_SPACE}+"), lambda w: w != "")


def repeated_words(words: Column, size: int = WINDOW) -> Column:
    """Number of words inside windows of ``size`` words that stand twice or more in the array."""
    hashes = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (size - 1)), lambda i: F.xxhash64(F.slice(h, i, size)))
    in_order = lambda x: F.sort_array(F.transform(x, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    twice = lambda s: F.filter(s, lambda x, k: (x["v"] == F.get(s, k - 1)["v"]) | (x["v"] == F.get(s, k + 1)["v"]))
    places = lambda s: F.sort_array(F.transform(twice(s), lambda x: x["i"]))
    covered = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(size), F.coalesce(F.get(p, k + 1) - x, F.lit(size)))), F.lit(0), lambda a, n: a + n)
    of_windows = lambda x: F.when(F.size(F.array_distinct(x)) == F.size(x), 0).otherwise(let(in_order(x), lambda s: let(places(s), covered)))
    return F.when(F.size(words) < size, 0).otherwise(let(hashes(words), lambda h: let(windows(h), of_windows))).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


class Measures:
    """What rules read of a text, each made only where a rule asks for it."""

    def __init__(self, text: Column, words: Column):
        self.text, self.words = text, words

    def n_words(self) -> Column:
        return F.size(self.words).cast("long")

    def word_chars(self) -> Column:
        return F.aggregate(self.words, F.lit(0).cast("long"), lambda a, x: a + F.length(x))

    def n_symbols(self) -> Column:
        return (F.length(self.text) - F.length(F.translate(self.text, "#*$%&|<>", ""))).cast("long")

    def lines(self) -> Column:
        """Struct of n (lines with a word) and dup (those equal to an earlier one)."""
        return let(_lines(self.text), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))

    def n_repeat_words(self) -> Column:
        return repeated_words(self.words)

    def n_lettered(self) -> Column:
        return F.size(F.filter(self.words, lambda x: x.rlike(r"\p{L}")))


class Known(Measures):
    """The same where the features are made already: rules read their fields."""

    def __init__(self, text: Column, words: Column, made: Column):
        super().__init__(text, words)
        for name in ("n_words", "word_chars", "n_symbols", "n_repeat_words"):
            setattr(self, name, lambda name=name: made[name])
        self.lines = lambda: F.struct(made["n_lines"].alias("n"), made["n_dup_lines"].alias("dup"))


def features(text: Column, words: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    m = Measures(text, words)
    return let(m.lines(), lambda x: F.struct(m.n_words().alias("n_words"), m.word_chars().alias("word_chars"), m.n_symbols().alias("n_symbols"), x["n"].alias("n_lines"), x["dup"].alias("n_dup_lines"), m.n_repeat_words().alias("n_repeat_words")))


#: Name -> measures -> true where the rule rejects. Each reads only what it needs.
RULES: dict[str, Callable[[Measures], Column]] = {
    "few_words": lambda m: m.n_words() < 10,
    "word_length": lambda m: let(m.word_chars(), lambda n: (n > 20 * m.n_words()) | (n < 2 * m.n_words())),
    "symbols": lambda m: 100 * m.n_symbols() > 25 * m.n_words(),
    "duplicate_lines": lambda m: let(m.lines(), lambda x: 100 * x["dup"] > 40 * x["n"]),
    "repeated_words": lambda m: 100 * m.n_repeat_words() > 20 * m.n_words(),
    "no_letters": lambda m: 10 * m.n_lettered() < 5 * m.n_words(),
}


def _spread(docs: DataFrame) -> DataFrame:
    """The rows of at most SAMPLE_FILES of the files that docs is read from, chosen by name; all rows of other tables."""
    files = docs.inputFiles()
    if len(files) <= SAMPLE_FILES:
        return docs
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(f,) for f in files], "f string").orderBy(F.xxhash64("f", F.lit(SEED)), "f").limit(SAMPLE_FILES)
    try:
        return docs.where(F.col("_metadata.file_path").isin([r.f for r in chosen.collect()]))
    except AnalysisException:  # docs is more than a scan
        return docs


def sampled(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> DataFrame:
    """A saved table of at most ``rows`` texts (t) with their words (w), of SAMPLE_BYTES together, drawn over docs by a seed.

    Longer texts than SAMPLE_BYTES are passed over: the sample decides only the order of rules.
    """
    of = _spread(docs)
    share = min(1.0, 4.0 * rows / max(of.count(), 1))
    texts = of.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t")).sample(fraction=share, seed=SEED)
    texts = texts.where(F.octet_length("t") <= SAMPLE_BYTES).withColumn("k", F.xxhash64("t", F.lit(SEED))).orderBy("k", "t").limit(rows)
    bytes_so_far = F.sum(F.octet_length("t")).over(Window.orderBy("k", "t").rowsBetween(Window.unboundedPreceding, 0))  # of at most ``rows`` rows
    return saved(texts.withColumn("b", bytes_so_far).where(F.col("b") <= SAMPLE_BYTES).select("t", words_of(F.col("t")).alias("w")).coalesce(1))


def measured(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS) -> tuple[dict[str, float], list[dict[str, bool]]]:
    """Seconds of each rule on TIMED_BYTES of sample text, less those of a rule that does nothing; each sample row's rejections.

    The words are at hand, as in the cascade. A rule is timed over the sample many times in one task, the
    better of two runs counts, and seconds are rounded to powers of two, so that reruns agree.
    """
    sample = sampled(docs, text_col, rows)
    m = Measures(F.col("t"), F.col("w"))
    size = sample.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    if not size:
        return dict.fromkeys(RULES, 1.0), []
    often = sample.select("t", "w", F.explode(F.sequence(F.lit(1), F.lit(max(1, round(TIMED_BYTES / size))))).alias("again"))

    def seconds(rule: Column) -> float:
        runs = []
        for _ in range(2):
            began = time.perf_counter()
            often.agg(F.count_if(rule)).first()
            runs.append(time.perf_counter() - began)
        return min(runs)

    idle = seconds(F.size("w") < F.col("again") - 1_000_000)
    costs = {name: 2.0 ** round(math.log2(max(seconds(rule(m)) - idle, 2.0**-6))) for name, rule in RULES.items()}
    rejected = sample.select(*[F.coalesce(rule(m), F.lit(False)).alias(name) for name, rule in RULES.items()]).collect()  # at most ``rows`` rows of booleans
    return costs, [r.asDict() for r in rejected]


def cascade_order(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """The rules: at each place the one that rejects most per second among the sample rows that are left.

    Ties go to the cheaper rule, then by name; so do rules that reject nothing.
    """
    costs, left = measured(docs, text_col, sample_rows)
    order, rest = [], sorted(RULES)
    while rest:
        best = min(rest, key=lambda n: (-sum(r[n] for r in left) / costs[n], costs[n], n))
        order.append(best)
        rest.remove(best)
        left = [r for r in left if not r[best]]
    return order


def judged(docs: DataFrame, text_col: str = "text", order: list[str] | None = None, with_features: bool = False) -> DataFrame:
    """docs with rejected_by: the first rule of the cascade that rejects, else null; later rules are not evaluated.

    With ``with_features`` also quality (struct of features): they are then made once for each row and the
    rules read them. Null and empty texts have no words and are rejected by few_words (or the first rule of
    the order that their zeros meet). Repeated rows and ties get equal verdicts; empty docs give no rows;
    columns of these names are replaced, all others kept.
    """
    order = order or cascade_order(docs, text_col)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))

    def cascade(m: Measures) -> Column:
        chain = None
        for name in order:
            chain = F.when(RULES[name](m), name) if chain is None else chain.when(RULES[name](m), name)
        return chain

    if not with_features:
        return docs.withColumn("rejected_by", let(words_of(text), lambda w: cascade(Measures(text, w))))
    made = let(words_of(text), lambda w: let(features(text, w), lambda f: F.struct(f.alias("features"), cascade(Known(text, w, f)).alias("rejected_by"))))
    name = free_name(docs, "judged")
    return docs.withColumn(name, made).withColumns({"quality": F.col(f"{name}.features"), "rejected_by": F.col(f"{name}.rejected_by")}).drop(name)
