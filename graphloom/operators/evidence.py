"""Evidence read-back: ordered collects, independent branches, caps, budgets, numbering, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scans import Ranges, plain


def ordered_list(order: list[str], *columns: str) -> Column:
    """Aggregate: the group's rows as structs, sorted by ``order``."""
    return F.sort_array(F.collect_list(F.struct(*order, *[c for c in columns if c not in order])))


def branches(owners: DataFrame, key: str, *aggregated: DataFrame, fill: dict[str, object] | None = None) -> DataFrame:
    """owners with each branch joined after it was aggregated by key, so no branch multiplies another."""
    for branch in aggregated:
        owners = owners.join(branch, key, "left")
    return owners.fillna(fill) if fill else owners


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key: the first in order, which should end with an id."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= k)


def ranked_at_scale(df: DataFrame, keys: list[str], rank: str, *order: Column) -> DataFrame:
    """df with the rank of each row among those of its keys, without gathering a key's rows in one task.

    Rows are dealt by ranges of keys and order (which should end with an id); counts of the ranges give offsets.
    """
    return plain(Ranges(df, keys, *order).numbered(rank))


def capped(df: DataFrame, keys: list[str], kind: str, caps: dict[str, int], *order: Column) -> DataFrame:
    """At most caps[kind] rows of each kind for each key; kinds without a cap are left out."""
    limit = F.create_map(*[F.lit(x) for pair in caps.items() for x in pair])
    return top_k(df.where(F.col(kind).isin(list(caps))), [*keys, kind], max(caps.values()), *order).where(F.col("rank") <= limit[F.col(kind)])


def within_budget(df: DataFrame, keys: list[str], size: str, budget: int, *order: Column) -> DataFrame:
    """The longest prefix of each group whose running size stays in the budget, with that size as used."""
    ranges = Ranges(df, keys, *order)
    ranges = ranges.kept(ranges.summed(F.col(size), "used"))
    return plain(ranges.greatest((F.col("used") > budget).cast("int"), "__over").where("__over = 0").drop("__over"))


def newest_within(df: DataFrame, keys: list[str], text: str, budget: int, *order: Column) -> DataFrame:
    """The newest rows (order: newest first) within a budget of characters; the one that passes it is cut to its last characters."""
    rows = Ranges(df, keys, *order).summed(F.length(text), "__used", inclusive=False).withColumn("__size", F.length(text))
    room = F.lit(budget) - F.col("__used")
    kept = rows.where(room > 0).withColumn(text, F.when(F.col("__size") <= room, F.col(text)).otherwise(F.right(F.col(text), room.cast("int"))))
    return plain(kept.drop("__size", "__used"))


def numbered(df: DataFrame, keys: list[str], *order: Column, prefix: str = "E") -> DataFrame:
    """evidence_id E1, E2, ... inside each group."""
    return ranked_at_scale(df, keys, "__n", *order).withColumn("evidence_id", F.concat(F.lit(prefix), F.col("__n").cast("string"))).drop("__n")


def linked(df: DataFrame, keys: list[str], value: str, *order: Column) -> DataFrame:
    """Previous and next value of each row in its group."""
    ranges = Ranges(df, keys, *order)
    ranges = ranges.kept(ranges.neighbour(F.col(value), "previous"))
    return plain(ranges.neighbour(F.col(value), "next", previous=False))


def islands(df: DataFrame, keys: list[str], start: str, end: str, gap: Column, *order: Column) -> DataFrame:
    """island number: a new one begins where start lies further than gap behind every end before."""
    ranges = Ranges(df, keys, *order)
    reach = ranges.greatest(F.col(end), "__reach", inclusive=False)
    begins = F.when(F.col("__reach").isNull() | (F.col(start) > F.col("__reach") + gap), 1).otherwise(0)
    ranges = ranges.kept(reach.withColumn("__new", begins).drop("__reach"))
    return plain(ranges.summed(F.col("__new"), "island").drop("__new"))


def in_listed_order(rows: DataFrame, key: str, listed: list) -> DataFrame:
    """The rows that a selection names, with their place in it; a repeated or unknown name is an error."""
    if len(set(listed)) != len(listed):
        raise ValueError("a selection names each row once")
    spark = rows.sparkSession
    chosen = spark.createDataFrame(list(enumerate(listed)), "position long, __key string").withColumn("__key", F.col("__key").cast(rows.schema[key].dataType))
    out = rows.join(F.broadcast(chosen), rows[key] == chosen["__key"]).drop("__key")
    if out.select(key).distinct().count() != len(listed):
        raise ValueError("a selection names an unknown row")
    return out
