"""Importance resampling towards a target text: hashed word runs, gains by bucket, the highest noisy scores.

A run's bucket comes from its CRC-32. Each word's CRC is made once; a longer run's follows from its parts'
by the algebra of CRCs: what stands before is moved by a length (a matrix over GF(2), made from powers of the
one for a single byte), and the sum is without carry. No run is ever written out as a string.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.evidence import ranked_at_scale
from .common import Chunk, chunks, map_texts, saved, scratch, ship_package
from .textkit import ALNUM, LOWER, word_spans

BUCKETS, MIN_WORDS, PERCENT, SEED = 10_000, 20, 10, 2024
#: Bytes of a word that all words go through side by side; longer words are summed one by one.
SIDE_BY_SIDE = 48
_X = np.uint32


def _byte_table() -> np.ndarray:
    c = np.arange(256, dtype=_X)
    for _ in range(8):
        c = np.where(c & _X(1), (c >> _X(1)) ^ _X(0xEDB88320), c >> _X(1))
    return c


def _tables(columns: np.ndarray) -> np.ndarray:
    """A 32 x 32 matrix over GF(2), given by its columns, as four tables for the four bytes of a vector."""
    out = np.zeros((4, 256), _X)
    for i in range(32):
        byte = np.arange(256) >> i % 8 & 1
        out[i // 8] ^= np.where(byte, columns[i], _X(0))
    return out


def _times(tables: np.ndarray, x: np.ndarray) -> np.ndarray:
    return tables[0][x & _X(255)] ^ tables[1][(x >> _X(8)) & _X(255)] ^ tables[2][(x >> _X(16)) & _X(255)] ^ tables[3][x >> _X(24)]


def _powers() -> list[np.ndarray]:
    """Matrices that move a CRC by 1, 2, 4, ... bytes."""
    basis = _X(1) << np.arange(32, dtype=_X)
    columns = BYTE[basis & _X(255)] ^ (basis >> _X(8))
    out = []
    for _ in range(32):
        out.append(_tables(columns))
        columns = _times(out[-1], columns)
    return out


BYTE = _byte_table()
POWERS = _powers()
SPACE = _X(zlib.crc32(b" "))


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of every span of bytes."""
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    begin, size = starts[order], length[order]
    crc = np.full(len(order), 0xFFFFFFFF, _X)
    for at in range(min(int(size[0]), SIDE_BY_SIDE) if len(size) else 0):
        n = int(np.searchsorted(-size, -at, "left"))  # words of more than ``at`` bytes stand first
        crc[:n] = BYTE[(crc[:n] ^ data[begin[:n] + at]) & _X(255)] ^ (crc[:n] >> _X(8))
    out = np.empty(len(order), _X)
    out[order] = ~crc
    for i in order[: int(np.searchsorted(-size, -SIDE_BY_SIDE, "left"))]:
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def moved(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs with as many bytes more behind them, of which only the number matters."""
    for k in range(int(length.max()).bit_length() if len(length) else 0):
        crc = np.where(length >> k & 1, _times(POWERS[k], crc), crc)
    return crc


def run_crcs(crc: np.ndarray, length: np.ndarray, first: np.ndarray, max_words: int):
    """(words, CRCs, index of the first word) of all runs of 1 to max_words words inside the texts, length by length."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at, run = np.arange(len(crc)), crc
    yield 1, run, at
    for k in range(2, max_words + 1):
        inside = at + k - 1 < first[1:][text[at]]
        at, run = at[inside], run[inside]
        last = at + k - 1
        run = moved(_times(POWERS[0], run) ^ SPACE, length[last]) ^ crc[last]
        yield k, run, at


def buckets_of(chunk: Chunk, max_words: int, n_buckets: int):
    """(bucket, text) of every feature, and each text's number of words."""
    lowered = LOWER[chunk.data]
    starts, ends, first = word_spans(lowered, chunk.offsets, ALNUM)
    crc = word_crcs(lowered, starts, ends)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    runs = [(run % _X(n_buckets), text[at]) for _, run, at in run_crcs(crc, ends - starts, first, max_words)]
    return np.concatenate([b for b, _ in runs]), np.concatenate([t for _, t in runs]), np.diff(first)


def feature_counts(table: DataFrame, text_col: str, max_words: int = 1, n_buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket; n_buckets numbers reach the driver, whatever the input."""

    def run(batches):
        sums = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for lo, hi in chunks(batch.column(0)):
                bucket, _, _ = buckets_of(Chunk(batch.column(0).slice(lo, hi - lo)), max_words, n_buckets)
                sums += np.bincount(bucket, minlength=n_buckets)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], names=["bucket", "n"])

    ship_package(table.sparkSession)
    rows = table.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_buckets, np.int64)
    out[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """floor(1000 * log of the smoothed target share over the smoothed source share) of each bucket."""
    n, t_all, s_all = len(target), float(target.sum()), float(source.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n)))) for t, s in zip(target, source)], np.int64)


def _weights(gain: np.ndarray, max_words: int):
    def step(chunk, rows):
        bucket, text, n_words = buckets_of(chunk, max_words, len(gain))
        size = np.bincount(text, minlength=len(chunk))
        order = np.argsort(text, kind="stable")
        total = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
        end = np.cumsum(size)
        return {"n_words": n_words, "n_features": size, "weight": total[end] - total[end - size]}

    return step


def noise(id_col: Column, seed: int) -> Column:
    """floor(1000 * a Gumbel variate) that only the seed and the id decide."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", max_words: int = 2, n_buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """A row for each row of docs: id, n_words, n_features, weight, score, rank (null for those not drawn).

    Features are all runs of 1 to max_words words. weight is the sum of the gains of a text's features, score
    adds noise that the seed and the id fix, and of the N texts of at least min_words words the
    floor(percent * N / 100) highest scores are drawn, ties to the smaller id. Null texts have no words; rows
    without id come first among ties and have the noise of an empty id; repeated rows are drawn each on their own,
    in an order that does not matter; empty docs give no rows, an empty target leaves the smoothing alone;
    other columns are not read. Two passes over the texts, then one sort by ranges of score and id.
    """
    keyed = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    gain = docs.sparkSession.sparkContext.broadcast(gains(feature_counts(target, target_text_col, max_words, n_buckets), feature_counts(keyed, "text", max_words, n_buckets)))
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("n_words", "n_features", "weight")])
    with scratch(docs.sparkSession):
        rows = map_texts(keyed, "text", lambda: _weights(gain.value, max_words), schema, ["id"])
        rows = saved(rows.withColumn("score", F.col("weight") + noise(F.col("id"), seed)))
        long_enough = F.col("n_words") >= min_words
        drawn = percent * rows.where(long_enough).count() // 100
        # the last column parts equal rows, so that no number of repeats lies in one range
        order = [F.desc("score"), F.col("id"), F.col("n_features"), F.col("weight"), F.col("salt")]
        ranked = ranked_at_scale(rows.where(long_enough).withColumn("salt", F.xxhash64(F.monotonically_increasing_id())), [], "place", *order).drop("salt")
        rank = F.when(F.col("place") <= drawn, F.col("place")).alias("rank")
        out = ranked.unionByName(rows.where(~long_enough).withColumn("place", F.lit(None).cast("long")))
        return saved(out.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", rank), keep=True)
