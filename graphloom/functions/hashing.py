"""Identities and content hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uid(kind: str, value: Column, length: int = 24) -> Column:
    """kind:first characters of the value's SHA-256."""
    return F.concat(F.lit(f"{kind}:"), F.substring(F.sha2(value.cast("binary"), 256), 1, length))


def crc_hex(value: Column) -> Column:
    return F.lpad(F.lower(F.hex(F.crc32(value.cast("binary")))), 8, "0")


def row_key(columns: list[str]) -> Column:
    """One string for a row's values: each with its length before it, a null as -, so different rows have different strings."""
    one = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.concat(*[one(F.col(f"`{c}`")) for c in columns])


def _digest(key: Column) -> list[Column]:
    """Two independent 60-bit numbers of a string's MD5, as decimals whose sum over 10^18 rows fits."""
    digest = F.md5(key.cast("binary"))
    return [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 17)]


def _summed(key: Column) -> Column:
    a, b = _digest(key)
    total = lambda x: F.coalesce(F.sum(x).cast("string"), F.lit("0"))
    return F.concat_ws("-", total(a), total(b))


def content_sums(columns: list[str]) -> list[Column]:
    """Aggregates: number of rows and an order-insensitive hash (two sums of 60-bit digests)."""
    return [F.count(F.lit(1)).alias("n_rows"), _summed(row_key(columns)).alias("content_hash")]


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the content sums, summed where the rows are."""
    return df.agg(*content_sums(columns))


def id_set_hash(df: DataFrame, by: str, id_col: str) -> DataFrame:
    """Per group: number of distinct ids and a hash of the set of ids; no group is gathered in a task."""
    distinct = df.select(by, F.col(id_col).cast("string").alias("__id")).distinct()
    return distinct.groupBy(by).agg(F.count("*").alias("n_ids"), _summed(F.col("__id")).alias("set_hash"))
