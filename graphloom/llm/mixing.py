"""Mixing sources to target weights: hash-random order inside each source, distributed prefix sums of
word counts, a cut at the source's exact budget, and whole epochs before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.evidence import ranked_at_scale
from .common import saved

WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2


def word_count(text_col: str):
    """Number of [^\\x20\\x09-\\x0D]+ in the text; 0 for null."""
    words = F.split(F.col(text_col), r"[\x20\x09-\x0D]+")
    return F.coalesce(F.size(words) - F.when(F.element_at(words, 1) == "", 1).otherwise(0) - F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """(source, source_size) with its weight and target.

    Sources take the weights by turns in code point order, null last. A target stops at epochs times its
    source's size, and what is over goes to the others by weight until none is above. Only two sums
    reach the driver in each round. Ranks come from ranges of source names, so there may be as many sources as rows.
    """
    ranked = ranked_at_scale(sizes, [], "rank", F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = saved(ranked.withColumn("weight", F.element_at(turn, ((F.col("rank") - 1) % len(weights) + 1).cast("int"))).drop("rank"))
    limit = F.lit(float(epochs)) * F.col("source_size")
    total = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        capped = F.col("weight") * level >= limit
        row = rows.agg(F.sum(F.when(capped, limit).otherwise(0.0)), F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))), F.count_if(capped)).first()
        if row[2] == full or not row[1]:
            break
        full, level = row[2], max(level, (total - row[0]) / row[1])
    return rows.withColumn("target", F.least(F.lit(level) * F.col("weight"), limit))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """A row for each row of docs: id, size, source_size, target, taken, source.

    Every document is taken floor(target / source_size) times whole; of the rest of the budget, the
    documents get their words in the order of md5(seed + id), the last one partly, so a source's taken
    words are its target rounded down, and no document exceeds ``epochs`` times its size. Null texts have
    size 0; null sources are one source; rows without id come in one place of the order; equal rows are
    interchangeable; empty docs give no rows; other columns are not read. A single hot source is spread over range partitions of the order.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(text_col).alias("size"), key.alias("key"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    sized = saved(sized)  # ranges are drawn from a sample: texts are split into words once, not for the sample too
    ranged = sized.repartitionByRange(parts, F.col("source").asc_nulls_last(), "key", "size").withColumn("part", F.spark_partition_id())
    ranged = saved(ranged)
    by_part = ranged.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    by_part = by_part.withColumn("offset", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    plan = targets(by_part.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, share, epochs)
    by_part = by_part.join(plan, by_part["source"].eqNullSafe(plan["source"])).select(by_part["source"].alias("s"), F.col("part").alias("p"), "offset", "source_size", "target")
    rows = ranged.join(by_part, ranged["source"].eqNullSafe(by_part["s"]) & (F.col("part") == F.col("p"))).drop("s", "p")
    inside = Window.partitionBy("source", "part").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    at = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    left = F.floor(F.col("target")) - rounds * F.col("source_size")
    taken = rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left - at))
    return rows.select(F.col("id").alias(id_col), "size", "source_size", F.col("target"), taken.cast("long").alias("taken"), F.col("source").alias("source"))
