"""A corpus pipeline of five stages: language, near-duplicates, benchmark passages, secrets, mixture.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns
of docs; the last adds what the mixture takes. Operators see a document as one struct beside its text, so
no column of docs, whatever its name, meets a column of theirs. Empty docs pass every stage as empty docs.
run() writes every stage as Parquet into the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, language_id, mixing, near_dedup, secrets
from graphloom.llm.common import saved, scratch


def _packed(docs: DataFrame, *more: Column) -> DataFrame:
    """Each document as the struct ``row``, with its text beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"), *more)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: those without any letter (or text) go, and those that score below what
    all but one in a thousand of the labelled texts reach. Where no language was learned, all with letters stay.
    Rows without id are learned from and judged as all others; repeated rows and ties get equal verdicts.
    """
    model = language_id.train(docs.where(~language_id.held_out()))
    if not model[0]:
        model = ["any"], np.ones((1, language_id.DIMENSIONS))  # only tells which texts have letters
        least = 0.0
        found = language_id.identify(_packed(docs), model, keep=["row"])
    else:
        found = saved(language_id.identify(_packed(docs), model, keep=["row"]))
        least = language_id.least_of(found.where("row.lang IS NOT NULL"))
    far = F.floor(F.col("score") * language_id.SCALE) < round(least * language_id.SCALE)
    return found.where((F.col("lang_pred") != language_id.UNKNOWN) & ~far).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the smallest id's.

    Rows without id come after all ids. Of rows of one id whose texts are in one group, the one with the
    smallest hash of its text stays, of those with one text the one with the smallest hash of its other
    columns; texts of one id that are no near copies are different documents and all stay. Null and
    wordless texts are no copies of anything and all stay, repeated ones too.
    """
    found = near_dedup.near_duplicates(docs, size=5, percent=80, groups=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_key")).alias("first")
    chosen = found.where("n_shingles > 0").groupBy("group_key").agg(first).select(F.col("first.doc_id").alias("chosen_id"), F.col("first.text_key").alias("chosen_key"))
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    rest_key = F.xxhash64(F.to_json(F.struct(*others))) if others else F.lit(0)
    keyed = _packed(docs, F.col("doc_id").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), rest_key.alias("rest_key"))
    has_words = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = keyed.where(has_words).join(chosen, F.col("id").eqNullSafe(F.col("chosen_id")) & (F.col("text_key") == F.col("chosen_key")), "left_semi")
    kept = own.groupBy("id", "text_key").agg(F.min_by("row", "rest_key").alias("row"))
    return kept.select("row.*").union(keyed.where(~has_words).select("row.*"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and wordless texts have none and stay; each repeated row is judged by itself; an empty benchmark
    takes nothing away.
    """
    found = decontaminate.contaminated_words(_packed(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["row"])
    return found.where(F.size("hit_words") == 0).select("row.*")


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, every secret in the text replaced by [SECRET]; n_chars follows where it is a column.

    Overlapping secrets become one mark; null texts stay null; repeated rows stay and are changed alike.
    """
    found = secrets.find_secrets(_packed(docs), keep=["row"], redact="[SECRET]")
    changed = {"text": F.col("redacted")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("secrets") > 0, F.length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mixture takes: doc_id, source, size, source_size, target, taken (words, repeats counted).

    Null sources are one source; null and wordless texts have size 0 and are not taken; repeated rows are
    taken each as a document of its own; other columns are not read.
    """
    mixed = mixing.mix_sources(docs)
    return mixed.where("taken > 0").select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_redaction), ("mixture", mixture)]
#: Signatures, hyperdimensional profiles and automata have no SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = saved(stage(spark, docs, sf_dir), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
