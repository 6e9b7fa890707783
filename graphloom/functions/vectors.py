"""Vector expressions over arrays, computed in double."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def dot(a: Column, b: Column) -> Column:
    product = lambda x, y: x.cast("double") * y.cast("double")
    return F.aggregate(F.zip_with(a, b, product), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null where either vector has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def unit_score(cos: Column) -> Column:
    """A cosine moved to 0..1."""
    return (1 + cos) / 2


def valid(a: Column, size: int, low: float = 0.99, high: float = 1.01) -> Column:
    """Right size, finite entries, length inside a window."""
    finite = F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce((F.size(a) == size) & finite & norm(a).between(low, high), F.lit(False))


def mean_unit(df: DataFrame, by: str, vector: str) -> DataFrame:
    """(by, pos, x): the mean of each group's vectors, scaled to length 1; sums are partial before the shuffle."""
    means = df.select(by, F.posexplode(vector).alias("pos", "x")).groupBy(by, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    length = means.groupBy(by).agg(F.sqrt(F.sum(F.col("m") * F.col("m"))).alias("length"))
    return means.join(length, by).select(by, "pos", F.try_divide("m", "length").alias("x"))


def box_valid(box: Column) -> Column:
    """Four numbers of 0..1000, left before right and top before bottom."""
    inside = F.forall(box, lambda v: v.between(0, 1000))
    return F.coalesce((F.size(box) == 4) & inside & (box[0] < box[2]) & (box[1] < box[3]), F.lit(False))
