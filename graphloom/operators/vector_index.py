"""Approximate and exact vector search over an inverted file: lists of vectors around centroids.

The centroids are learned from a bounded sample; every vector is assigned and stored under its nearest one,
a list for each partition folder. A search scores the centroids, reads the lists it probes and ranks their vectors
by exact cosine. A list's radius bounds the cosine of all its vectors, which makes the search exact where asked for.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vectors
from ..runtime import saved, ship_package

#: Most lists, vectors of the sample for each list, rounds of learning, probed lists, and vectors and queries that meet in one
#: task. Centroids and sample are what reaches the driver: MAX_LISTS vectors and SAMPLE times as many.
MAX_LISTS, SAMPLE, ROUNDS, PROBES, BLOCK, QUERIES = 1024, 64, 12, 8, 1 << 15, 512
#: Scores are rounded, so that equal vectors tie whatever the order of their sums.
DIGITS = 9
_LISTS = "list int, n long, least double, center array<double>"


def unit_rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of a list array as rows of length 1, and which rows have a length; null and zero vectors have none."""
    lists = lists.cast(pa.large_list(pa.float64()))
    size = np.diff(lists.offsets.to_numpy())
    dim = int(size.max()) if len(size) else 0
    good = (size == dim) & (dim > 0)
    flat = lists.flatten().fill_null(float("nan")).to_numpy()
    rows = np.zeros((len(size), dim))
    if dim:
        rows[good] = flat[np.repeat(good, size)].reshape(-1, dim)
    length = np.sqrt((rows * rows).sum(axis=1))
    good &= np.isfinite(length) & (length > 0)
    rows[good] /= length[good, None]
    rows[~good] = 0
    return rows, good


def centroids(sample: np.ndarray, n_lists: int, seed: int = 0, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means: unit centroids; a list that loses all its vectors takes the one that fits worst."""
    if not len(sample):
        return sample
    rng = np.random.default_rng(seed)
    n_lists = min(n_lists, len(sample))
    centers = sample[rng.choice(len(sample), n_lists, replace=False)]
    for _ in range(rounds):
        score = sample @ centers.T
        own = score.argmax(axis=1)
        fit = score[np.arange(len(sample)), own]
        sums = np.zeros_like(centers)
        np.add.at(sums, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=n_lists) == 0)
        sums[empty] = sample[np.argsort(fit, kind="stable")[: len(empty)]]
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(length > 0, sums / np.where(length > 0, length, 1), centers)
    return centers


class VectorIndex:
    """An inverted file that was built once: vectors by list, and a table of the lists."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = T.StructType.fromJson(json.loads(spark.read.schema("s string").json(f"{self.path}/about").first().s))
        rows = spark.read.schema(_LISTS).parquet(f"{self.path}/lists").orderBy("list").collect()  # MAX_LISTS rows at most
        self.lists = [r.list for r in rows]
        self.sizes = np.array([r.n for r in rows], np.int64)
        self.centers = np.array([r.center for r in rows]) if rows else np.zeros((0, 0))
        self.radius = np.arccos(np.clip(np.array([r.least for r in rows]), -1, 1))

    @classmethod
    def build(cls, table: DataFrame, id_col: str, vector_col: str, path: str, n_lists: int | None = None, seed: int = 0) -> VectorIndex:
        """Write the index of all vectors that have a length; by default it has the root of their number as lists."""
        spark, path = table.sparkSession, path.rstrip("/")
        ship_package(spark)
        rows = table.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
        if n_lists is None:
            n_lists = math.isqrt(rows.where("vector IS NOT NULL").count())
        n_lists = max(1, min(n_lists, MAX_LISTS))
        drawn = rows.where("vector IS NOT NULL").orderBy(F.xxhash64(F.col("id"), F.lit(seed))).limit(SAMPLE * n_lists).select("vector").toArrow()
        sample, good = unit_rows(drawn.column(0).combine_chunks())
        centers = centroids(sample[good], n_lists, seed)
        shared = spark.sparkContext.broadcast(centers)
        schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("fit", T.DoubleType())])

        def assigned(batches):
            for batch in batches:
                x, good = unit_rows(batch.column(1))
                if not len(shared.value) or x.shape[1] != shared.value.shape[1]:
                    continue
                score = x @ shared.value.T
                own = score.argmax(axis=1)
                out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own.astype(np.int32)), pa.array(score[np.arange(len(x)), own])], names=schema.names)
                yield out.filter(pa.array(good))

        # a list that holds most vectors is written by several tasks, small ones by one
        rows.mapInArrow(assigned, schema).hint("rebalance", "list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
        middle = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centers)], "list int, center array<double>")
        written = spark.read.schema(schema).parquet(f"{path}/vectors")
        lists = written.groupBy("list").agg(F.count("*").alias("n"), F.min("fit").alias("least")).join(F.broadcast(middle), "list")
        lists.select("list", "n", "least", "center").coalesce(1).write.mode("overwrite").parquet(f"{path}/lists")
        spark.createDataFrame([(schema.json(),)], "s string").coalesce(1).write.mode("overwrite").json(f"{path}/about")
        return cls(spark, path)

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/vectors")

    def probed(self, query: Sequence[float], probes: int, k: int = 1) -> list[int]:
        """Numbers of the lists nearest to a query: ``probes`` of them, or as many more as hold k vectors."""
        q = np.asarray(query, float)
        order = np.argsort(-(self.centers @ q), kind="stable") if len(self.lists) else np.zeros(0, int)
        enough = int(np.searchsorted(np.cumsum(self.sizes[order]), k)) + 1
        return order[: max(probes, enough)].tolist()

    def search(self, query: Sequence[float], k: int = 10, probes: int = PROBES, exact: bool = False) -> DataFrame:
        """(id, score) of the k best by cosine, ties to the smaller id; only the folders of the probed lists are read.

        With ``exact`` all lists whose radius lets one of their vectors reach the probed lists' k-th score are read as well.
        """
        near = self.probed(query, probes, k)
        found = self._best(query, near, k)
        if not exact:
            return found
        scores = [r.score for r in found.select("score").collect()]  # k rows
        least = min(scores) if len(scores) == k else -1.0
        return self._best(query, self.reachable(query, least), k)

    def reachable(self, query: Sequence[float], score: float) -> list[int]:
        """Numbers of the lists that may hold a vector of at least this score: by the angles to centroid and radius."""
        q = np.asarray(query, float)
        length = np.linalg.norm(q)
        if not length or not len(self.lists):
            return []
        angle = np.arccos(np.clip(self.centers @ (q / length), -1, 1))
        return np.flatnonzero(np.cos(np.maximum(0, angle - self.radius)) >= score - 10.0**-DIGITS - 1e-7).tolist()

    def _best(self, query: Sequence[float], near: list[int], k: int) -> DataFrame:
        rows = self.vectors().where(F.col("list").isin([self.lists[i] for i in near]))
        score = F.round(vectors.cosine(F.col("vector"), vectors.literal(query)), DIGITS)
        return rows.select("id", score.alias("score")).where("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(k)

    def search_all(self, queries: DataFrame, k: int = 10, probes: int | None = PROBES) -> DataFrame:
        """(query, rank, id, score): the k best of each row of queries(id, vector); all lists where probes is None.

        Queries go to the lists they probe, and there meet the list's vectors in blocks of BLOCK by QUERIES; a block gives k
        rows for each of its queries. A query whose vector has no length has no rows.
        """
        centers, lists = self.spark.sparkContext.broadcast(self.centers), self.lists
        n = len(lists) if probes is None else min(probes, len(lists))
        ship_package(self.spark)
        kind = queries.schema["id"].dataType
        asked = T.StructType([T.StructField("query", kind), T.StructField("wanted", T.ArrayType(T.DoubleType())), T.StructField("list", T.IntegerType())])

        def to_lists(batches):
            for batch in batches:
                x, good = unit_rows(batch.column(1))
                rows = np.flatnonzero(good)
                if not len(rows) or not n or x.shape[1] != centers.value.shape[1]:
                    continue
                near = np.argsort(-(x[rows] @ centers.value.T), axis=1, kind="stable")[:, :n]
                take = pa.array(np.repeat(rows, n))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(np.array(lists, np.int32)[near.reshape(-1)])], names=asked.names)

        dealt = saved(queries.select("id", F.col("vector").cast("array<double>")).mapInArrow(to_lists, asked))
        held = self.spark.createDataFrame([(i, int(-(-s // BLOCK))) for i, s in zip(lists, self.sizes)], "list int, blocks int")
        parts = dealt.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")).join(held, "list")  # MAX_LISTS rows
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        deal = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
        q = dealt.join(F.broadcast(parts), "list").select("query", "wanted", "list", deal("query", "parts").alias("part"), every("blocks").alias("block"))
        v = self.vectors().join(F.broadcast(parts), "list").select("id", "vector", "list", deal("id", "blocks").alias("block"), every("parts").alias("part"))
        out = T.StructType([T.StructField("query", kind), T.StructField("id", v.schema["id"].dataType), T.StructField("score", T.DoubleType())])

        def met(left: pa.Table, right: pa.Table) -> pa.Table:
            a, b = (unit_rows(t.column(1).combine_chunks())[0] for t in (left, right))
            if not len(a) or not len(b):
                return out_of(left, right, np.zeros(0, int), np.zeros(0, int), np.zeros(0))
            score = np.round(a @ b.T, DIGITS)
            if score.shape[1] > k:  # the k-th score and what ties with it; ties are cut when all blocks are together
                least = np.partition(score, -k, axis=1)[:, -k]
                x, y = np.nonzero(score >= least[:, None])
            else:
                x, y = np.nonzero(np.ones(score.shape, bool))
            return out_of(left, right, x, y, score[x, y])

        def out_of(left, right, x, y, score):
            return pa.table([left.column(0).take(pa.array(x)), right.column(0).take(pa.array(y)), pa.array(score)], names=out.names)

        keys = ["list", "part", "block"]
        met_rows = q.select("query", "wanted", *keys).groupBy(*keys).cogroup(v.select("id", "vector", *keys).groupBy(*keys)).applyInArrow(met, out)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return met_rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "id", "score")

    def probes_for(self, queries: DataFrame, k: int = 10, recall: float = 0.95) -> int:
        """The fewest probes that find this share of the true k nearest of ``queries``: measured, for a corpus whose vectors
        lie in groups few are enough, for one without any structure most lists are needed. One row for each number of
        probes reaches the driver."""
        truth = self.search_all(queries, k, None).join(self.vectors().select("id", "list"), "id").join(queries.select(F.col("id").alias("query"), F.col("vector").cast("array<double>")), "query")
        centers, number = self.spark.sparkContext.broadcast(self.centers), {x: i for i, x in enumerate(self.lists)}

        def places(batches):
            for batch in batches:
                x, _ = unit_rows(batch.column(1))
                order = np.argsort(np.argsort(-(x @ centers.value.T), axis=1, kind="stable"), axis=1)
                own = np.array([number[v] for v in batch.column(0).to_pylist()], int)
                yield pa.RecordBatch.from_arrays([pa.array(order[np.arange(len(own)), own].astype(np.int64))], names=["place"])

        counts = truth.select("list", "vector").mapInArrow(places, "place long").groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()
        reached, total = 0, sum(r.n for r in counts)
        for r in counts:
            reached += r.n
            if reached >= recall * total:
                return r.place + 1
        return max(1, len(self.lists))

    def recall(self, queries: DataFrame, k: int = 10, probes: int = PROBES) -> DataFrame:
        """One row: queries, recall of their k best against all lists (a hit is any vector of the true k-th score or more), and
        the share of vectors that a query's probes read."""
        truth = self.search_all(queries, k, None).groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        found = self.search_all(queries, k, probes)
        hits = found.join(truth, "query").where("score >= least").groupBy("query").agg(F.least(F.count("*"), F.max("n")).alias("hits"))
        both = truth.join(hits, "query", "left")
        row = both.agg(F.count("*").alias("n_queries"), F.avg(F.coalesce("hits", F.lit(0)) / F.col("n")).alias("recall"))
        return row.withColumn("read", F.lit(float(min(1.0, probes / max(1, len(self.lists))))))
