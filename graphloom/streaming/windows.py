"""Windows over events: the same expressions serve batch tables and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _start(w):
    return F.unix_seconds(w["start"].cast("timestamp")).alias("start")


def tumbling(events: DataFrame, at: str, seconds: int, by: list[str], value: str) -> DataFrame:
    w = events.groupBy(*by, F.window(at, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return w.select(*by, _start(F.col("w")), "n", "total")


def sliding(events: DataFrame, at: str, seconds: int, slide: int, by: list[str]) -> DataFrame:
    w = events.groupBy(*by, F.window(at, f"{seconds} seconds", f"{slide} seconds").alias("w")).agg(F.count("*").alias("n"))
    return w.select(*by, _start(F.col("w")), "n")


def sessions(events: DataFrame, at: str, gap: int, by: list[str]) -> DataFrame:
    w = events.groupBy(*by, F.session_window(at, f"{gap} seconds").alias("w")).agg(F.count("*").alias("n"))
    return w.select(*by, _start(F.col("w")), "n")


def late_tolerant(stream: DataFrame, at: str, lateness: str, id_col: str) -> DataFrame:
    """A stream with a watermark, each id once inside it."""
    return stream.withWatermark(at, lateness).dropDuplicatesWithinWatermark([id_col])


def latest_alive(rows: DataFrame, key: str, at: str, ttl_seconds: int, now) -> DataFrame:
    """The last row of each key, where it is not older than its time to live; later rows win, also if they come earlier."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.col(at)).alias("__r"))
    return last.select(key, "__r.*").where(F.unix_seconds(F.col(at).cast("timestamp")) >= F.lit(now) - ttl_seconds)
