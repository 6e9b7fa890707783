"""Audits: each returns violations or counts, never a side effect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import saved
from .scans import Ranges, plain

#: Unknown ids that are looked up where the edges are; more are dealt.
FEW = 1 << 16


def exactly_once(owners: DataFrame, uses: DataFrame, key: str) -> DataFrame:
    """Owners that are used any other number of times than once, with that number."""
    counts = uses.groupBy(key).agg(F.count("*").alias("n"))
    return owners.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n")).where("n <> 1")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once or hold a null."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys]))


def dangling(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    return edges.join(nodes.select(key), key, "left_anti")


def reconcile(expected: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """Keys whose values differ, null counting as a value."""
    a = expected.select(key, F.col(value).alias("expected"))
    b = found.select(key, F.col(value).alias("found"))
    return a.join(b, key, "full").where(~F.col("expected").eqNullSafe(F.col("found")))


def same_ids(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many ids are only in a, only in b, and whether the sets are equal."""
    x = a.select(key).distinct().withColumn("a", F.lit(1)).join(b.select(key).distinct().withColumn("b", F.lit(1)), key, "full")
    return x.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b")).withColumn("equal", (F.col("only_a") == 0) & (F.col("only_b") == 0))


def counts_row(**tables: DataFrame) -> DataFrame:
    """One row with the number of rows of each table."""
    parts = [df.agg(F.count("*").alias(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each


def violations(df: DataFrame, id_col: str, rules: dict[str, Column]) -> DataFrame:
    """(id, reason): a row for each rule that a row breaks; a rule that is null is broken."""
    broken = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(n)) for n, rule in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.col(id_col), F.explode(broken).alias("reason"))


def span_matches(text: Column, start: Column, end: Column, name: Column) -> Column:
    """The text between two code points is the name."""
    return F.substring(text, start + 1, end - start) == name


def coverage_gaps(fragments: DataFrame, owner: str, start: str, end: str, length: str) -> DataFrame:
    """Owners whose fragments leave a gap, overlap or stop short of the whole length."""
    gaps = Ranges(fragments, [owner], start, end).neighbour(F.col(end), "__before").withColumn("__before", F.coalesce("__before", F.lit(0))).groupBy(owner)
    out = gaps.agg(F.count_if(F.col(start) > F.col("__before")).alias("n_gaps"), F.count_if(F.col(start) < F.col("__before")).alias("n_overlaps"), F.max(end).alias("covered"), F.max(length).alias("length"))
    return out.where("n_gaps > 0 OR n_overlaps > 0 OR covered <> length")


def is_permutation(output: Column, given: Column) -> Column:
    return F.array_sort(output).eqNullSafe(F.array_sort(given))


def citations_owned(answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """answers(answer_id, owner, citations, numbers) with unknown and foreign citations counted, and numbers
    that no cited evidence(evidence_id, owner, numbers) holds."""
    cited = answers.select("answer_id", F.col("owner").alias("asked"), F.explode_outer("citations").alias("evidence_id"))
    found = cited.join(evidence.select("evidence_id", F.col("owner").alias("source"), F.col("numbers").alias("held")), "evidence_id", "left")
    by_answer = found.groupBy("answer_id").agg(F.count_if(F.expr("evidence_id IS NOT NULL AND source IS NULL")).alias("n_unknown"), F.count_if(F.expr("source <> asked")).alias("n_foreign"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("held", F.array().cast("array<string>"))))).alias("held"))
    out = answers.join(by_answer, "answer_id")
    return out.select("answer_id", "n_unknown", "n_foreign", F.size(F.array_except("numbers", "held")).alias("n_unsupported")).withColumn("valid", F.expr("n_unknown = 0 AND n_foreign = 0 AND n_unsupported = 0"))


def misplaced(rows: DataFrame, keys: list[str], place: str, order: str) -> DataFrame:
    """Rows whose place is not their number (from 0) in the order of their keys."""
    return plain(Ranges(rows, keys, order).numbered("__n").where(F.col("__n") - 1 != F.col(place)).drop("__n"))


def changed_values(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change) of rows that are new, gone or of other values."""
    mark = lambda df, name: df.select(key, F.xxhash64(*columns).alias(name))
    both = mark(before, "__a").join(mark(after, "__b"), key, "full")
    change = F.when(F.col("__a").isNull(), "new").when(F.col("__b").isNull(), "gone").when(F.col("__a") != F.col("__b"), "changed")
    return both.select(key, change.alias("change")).where("change IS NOT NULL")


def scope_proof(nodes: DataFrame, edges: DataFrame, expected: DataFrame, id_col: str) -> DataFrame:
    """One row: expected, found and missing ids, edges that leave the nodes, and whether all is there and nothing else."""
    ids = same_ids(expected.select(F.col(id_col).alias("id")), nodes.select("id"), "id")
    known = nodes.select("id").distinct()
    # An id is looked up once, however many edges name it; only the edges of unknown ids are made again.
    named = edges.select(F.explode(F.array("start_id", "end_id")).alias("id")).distinct()
    unknown = saved(named.where("id IS NOT NULL").join(known, "id", "left_anti"))
    small = unknown.limit(FEW + 1).count() <= FEW
    of = lambda end: F.broadcast(unknown.withColumnRenamed("id", end)) if small else unknown.withColumnRenamed("id", end)
    at = [edges.join(of(end), end, "left_semi") for end in ("start_id", "end_id")]
    loose = at[0].unionByName(at[1]).unionByName(edges.where("start_id IS NULL OR end_id IS NULL")).distinct()
    out = ids.crossJoin(loose.agg(F.count("*").alias("loose_edges")))  # one row each
    return out.select(F.col("only_a").alias("missing"), F.col("only_b").alias("unexpected"), "loose_edges", (F.col("equal") & (F.col("loose_edges") == 0)).alias("complete"))
