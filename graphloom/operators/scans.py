"""Scans along an order inside keys, of which any may hold all rows: ranges with carries.

Rows are dealt by ranges of keys and order. What a range adds to a scan (a sum, a maximum, its last row) is one
small row for each key and range, and a scan over these rows gives what is carried into a range; the rest happens
inside ranges. So no window ever runs over a whole key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import saved

PART, TIE = "__part", "__tie"


def plain(rows: DataFrame) -> DataFrame:
    """Rows without the columns that ranges add."""
    return rows.drop(PART, TIE)


class Ranges:
    """A table dealt by ranges of its keys and an order, which should end with an id: what ties stays in one range,
    in an order that is the same for all scans over it."""

    def __init__(self, df: DataFrame, keys: list[str], *order: Column | str, parts: int | None = None):
        self.keys, self.order = keys, [F.col(c) if isinstance(c, str) else c for c in order]
        parts = parts or max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *self.order)
        self.rows = saved(ranged.withColumns({PART: F.spark_partition_id(), TIE: F.monotonically_increasing_id()}))

    @property
    def inside(self):
        """The window of a row's key and range."""
        return Window.partitionBy(*self.keys, PART).orderBy(*self.order, TIE)

    @property
    def before(self):
        return self.inside.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def upto(self):
        return self.inside.rowsBetween(Window.unboundedPreceding, 0)

    def kept(self, rows: DataFrame) -> Ranges:
        """The same ranges over rows with other columns, written so that what made them is not made again."""
        out = object.__new__(Ranges)
        out.keys, out.order, out.rows = self.keys, self.order, saved(rows)
        return out

    def ends(self, value: Column, last: bool) -> DataFrame:
        """(keys, range, value) of the last or first row of each key's range."""
        beyond = (F.lead if last else F.lag)(F.lit(1)).over(self.inside)
        return self.rows.withColumn("__end", beyond.isNull()).where("__end").select(*self.keys, PART, value.alias("__carry"))

    def carried(self, summary: DataFrame, carry: Column | None, name: str) -> DataFrame:
        """The rows with what ``carry`` makes of the summaries(keys, range, __carry) of their key, as column ``name``.

        carry is an expression over the window of a key's ranges: one row for each range that the key reaches.
        """
        mine = summary.withColumn("__carry", carry).select(*[F.col(k).alias(f"__{i}") for i, k in enumerate(self.keys)], F.col(PART).alias("__at"), F.col("__carry").alias(name))
        same = F.col(PART) == F.col("__at")
        for i, k in enumerate(self.keys):
            same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"__{i}"))
        return self.rows.join(mine, same).drop("__at", *[f"__{i}" for i in range(len(self.keys))])

    def _ranges(self):
        return Window.partitionBy(*self.keys).orderBy(PART)

    def _earlier(self, fold):
        return fold("__carry").over(self._ranges().rowsBetween(Window.unboundedPreceding, -1))

    def summed(self, value: Column, name: str, inclusive: bool = True) -> DataFrame:
        """The rows with the sum of the values up to (or before) them in their key; nulls add nothing."""
        parts = self.rows.groupBy(*self.keys, PART).agg(F.sum(value).alias("__carry"))
        rows = self.carried(parts, F.coalesce(self._earlier(F.sum), F.lit(0)), "__base")
        own = F.coalesce(F.sum(value).over(self.upto if inclusive else self.before), F.lit(0))
        return rows.withColumn(name, F.col("__base") + own).drop("__base")

    def greatest(self, value: Column, name: str, inclusive: bool = True) -> DataFrame:
        """The rows with the greatest value up to (or before) them in their key; null where there is none."""
        parts = self.rows.groupBy(*self.keys, PART).agg(F.max(value).alias("__carry"))
        rows = self.carried(parts, self._earlier(F.max), "__base")
        return rows.withColumn(name, F.greatest(F.col("__base"), F.max(value).over(self.upto if inclusive else self.before))).drop("__base")

    def neighbour(self, value: Column, name: str, previous: bool = True) -> DataFrame:
        """The rows with the value of the row before (or behind) them in their key; null at its end."""
        step = F.lag if previous else F.lead
        rows = self.carried(self.ends(value, previous), step("__carry").over(self._ranges()), "__base")
        there = step(F.lit(1)).over(self.inside).isNotNull()
        return rows.withColumn(name, F.when(there, step(value).over(self.inside)).otherwise(F.col("__base"))).drop("__base")

    def numbered(self, name: str) -> DataFrame:
        """The rows with their number in their key, from 1."""
        parts = self.rows.groupBy(*self.keys, PART).agg(F.count(F.lit(1)).alias("__carry"))
        rows = self.carried(parts, F.coalesce(self._earlier(F.sum), F.lit(0)), "__base")
        return rows.withColumn(name, (F.col("__base") + F.row_number().over(self.inside)).cast("long")).drop("__base")
