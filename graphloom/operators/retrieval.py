"""Lexical, dense and fused rankings."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text, vectors
from ..runtime import saved, ship_package
from .evidence import ranked_at_scale

K1, B, RRF_K, SEEDS = 1.5, 0.75, 60, 50


class LexicalIndex:
    """Lexical scores of a table of texts, and its postings(id, term, tf)."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.tokenised = docs.select(F.col(id_col).alias("id"), text.tokens(F.col(text_col)).alias("words"))

    @property
    def postings(self) -> DataFrame:
        """Terms are counted where a text's tokens are, so a row is shuffled for each term of a text, not for each token."""
        ship_package(self.tokenised.sparkSession)
        kind = self.tokenised.schema["id"].dataType
        schema = T.StructType([T.StructField("id", kind), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
        return self.tokenised.where("size(words) > 0").mapInArrow(_term_counts, schema)

    def scores(self, query: Sequence[str], k1: float = K1, b: float = B) -> DataFrame:
        """(id, bm25) of every text, 0 without a match; the query's terms are a set.

        Texts are tokenised once: what stays of them is their length and how often each term of the query
        stands in them. One row of statistics reaches the driver, and scores need no shuffle.
        """
        terms = sorted(set(query))
        if not terms:
            return self.tokenised.select("id", F.lit(0.0).alias("bm25"))
        found = lambda w: F.filter(w, lambda x: x.isin(terms))
        rows = self.tokenised.select("id", F.size("words").alias("length"), found(F.col("words")).alias("hits"))
        times = lambda t: F.size(F.filter("hits", lambda x: x == t))
        rows = saved(rows.select("id", "length", *[times(t).alias(f"tf{i}") for i, t in enumerate(terms)]))
        whole = rows.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).first()
        score = F.lit(0.0)
        for i in range(len(terms)):
            tf, df = F.col(f"tf{i}"), whole[f"df{i}"]
            idf = math.log1p((whole.n - df + 0.5) / (df + 0.5))
            score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("length") / F.lit(whole.avgdl or 1.0)))
        return rows.select("id", score.alias("bm25"))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = batch.column(1)
        names = words.flatten().dictionary_encode()
        row = np.repeat(np.arange(len(batch)), np.diff(words.offsets.to_numpy()))
        size = max(len(names.dictionary), 1)
        pairs, tf = np.unique(row * size + names.indices.to_numpy(), return_counts=True)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(pairs // size)), names.dictionary.take(pa.array(pairs % size)).cast(pa.string()), pa.array(tf)], names=["id", "term", "tf"])


class StoredIndex:
    """A lexical index that was built once: postings by buckets of terms, document frequencies, lengths, statistics."""

    BUCKETS = 64

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_col: str, path: str) -> StoredIndex:
        """Write the index of docs; an earlier one at the path is replaced."""
        index = LexicalIndex(docs, id_col, text_col)
        path = path.rstrip("/")
        bucket = F.pmod(F.xxhash64("term"), F.lit(cls.BUCKETS)).alias("bucket")
        lengths = index.tokenised.select("id", F.size("words").alias("length"))
        lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        postings = index.postings.select("id", "term", "tf", bucket).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
        postings.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        written = docs.sparkSession.read.parquet(f"{path}/postings")
        written.groupBy("bucket", "term").agg(F.count("*").alias("df")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/terms")
        return cls(docs.sparkSession, path)

    def _of(self, table: str, terms: list[str]) -> DataFrame:
        buckets = self.spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(self.BUCKETS)).alias("b")).distinct()
        return self.spark.read.parquet(f"{self.path}/{table}").where(F.col("bucket").isin([r.b for r in buckets.collect()]) & F.col("term").isin(terms))

    def scores(self, query: Sequence[str], k1: float = K1, b: float = B) -> DataFrame:
        """(id, bm25) of the texts that match; only the buckets of the query's terms are read."""
        terms = sorted(set(query))
        lengths = self.spark.read.parquet(f"{self.path}/lengths")
        whole = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl")).first()
        idf = F.log1p((whole.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        fit = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(whole.avgdl or 1.0)))
        frequencies = self._of("terms", terms).select("term", "df")  # one row a term of the query
        return self._of("postings", terms).join(F.broadcast(frequencies), "term").join(lengths, "id").groupBy("id").agg(F.sum(idf * fit).alias("bm25"))


def dense_scores(table: DataFrame, id_col: str, vector_col: str, query: Sequence[float], among: DataFrame | None = None) -> DataFrame:
    """(id, dense): cosine with the query; ``among``(id) qualifies rows before any is scored."""
    rows = table.select(F.col(id_col).alias("id"), vector_col)
    if among is not None:
        rows = rows.join(among.select("id"), "id", "left_semi")
    return rows.select("id", vectors.cosine(F.col(vector_col), vectors.literal(query)).alias("dense"))


def seeds(scores: DataFrame, score: str, n: int = SEEDS, positive: bool = True) -> DataFrame:
    """The n best by score, then id."""
    rows = scores.where(F.col(score) > 0) if positive else scores
    return rows.orderBy(F.desc(score), "id").limit(n)


def pool_ranks(pool: DataFrame, score: str, rank: str, positive: bool, keys: list[str] | None = None) -> DataFrame:
    """Ranks by score inside a pool (or each pool of keys); rows without a score (or a positive one) have none.

    A pool holds all of the graph's candidates, so ranks come from ranges, not from one task's sort.
    """
    has = F.coalesce((F.col(score) > 0) if positive else F.col(score).isNotNull(), F.lit(False))
    ranked = ranked_at_scale(pool.where(has), keys or [], rank, *[F.desc(score), F.col("id")])
    return ranked.unionByName(pool.where(~has).withColumn(rank, F.lit(None).cast("long")))


def reciprocal(rank: str, k: int = RRF_K) -> Column:
    return F.coalesce(1.0 / (F.lit(k) + F.col(rank)), F.lit(0.0))


def pool_rrf(lexical: DataFrame, dense: DataFrame, graph: DataFrame, eligible: DataFrame | None = None, seeds_each: int = SEEDS, k: int = RRF_K, limit: int = 10) -> DataFrame:
    """Seeds of both lists and the graph's candidates, filtered, ranked anew inside the pool and fused.

    The filter comes after the seeds and nothing refills them. Columns: id, bm25, dense, bm25_rank,
    dense_rank, from_graph, rrf, position.
    """
    ids = seeds(lexical, "bm25", seeds_each).select("id").union(seeds(dense, "dense", seeds_each, positive=False).select("id")).union(graph.select("id")).distinct()
    if eligible is not None:
        ids = ids.join(eligible.select("id"), "id", "left_semi")
    pool = ids.join(lexical, "id", "left").join(dense, "id", "left").join(graph.select("id", F.lit(True).alias("from_graph")).distinct(), "id", "left")
    pool = pool.withColumns({"from_graph": F.coalesce("from_graph", F.lit(False)), "bm25": F.coalesce("bm25", F.lit(0.0))})
    ranked = pool_ranks(pool_ranks(pool, "bm25", "bm25_rank", True), "dense", "dense_rank", False)
    fused = ranked.withColumn("rrf", reciprocal("bm25_rank", k) + reciprocal("dense_rank", k))
    best = fused.orderBy(F.desc("rrf"), "id").limit(limit)
    return best.withColumn("position", F.row_number().over(Window.orderBy(F.desc("rrf"), "id")))  # limit rows


def method_matrix(methods: dict[str, tuple[DataFrame | None, DataFrame | None, DataFrame | None]], filters: dict[str, DataFrame | None], seeds_each: int = SEEDS, k: int = RRF_K, limit: int = 10) -> DataFrame:
    """(method, variant, id, from_graph, bm25_rank, dense_rank, rrf, position): every method under every filter.

    A method is its lexical scores, dense scores and graph candidates, each or none; a variant's filter comes
    after the seeds. All pools are ranked in one table, keyed by method and variant.
    """
    pools = None
    for name, (lexical, dense, graph) in methods.items():
        lists = [seeds(x, c, seeds_each, positive).select("id") for x, c, positive in ((lexical, "bm25", True), (dense, "dense", False)) if x is not None]
        found = [x.withColumn("from_graph", F.lit(False)) for x in lists] + ([graph.select("id", F.lit(True).alias("from_graph"))] if graph is not None else [])
        ids = reduce(DataFrame.unionByName, found).groupBy("id").agg(F.max("from_graph").alias("from_graph"))
        for scores, column in ((lexical, "bm25"), (dense, "dense")):
            ids = ids.join(scores.select("id", column), "id", "left") if scores is not None else ids.withColumn(column, F.lit(None).cast("double"))
        for variant, allowed in filters.items():
            rows = ids if allowed is None else ids.join(allowed.select("id"), "id", "left_semi")
            rows = rows.withColumns({"method": F.lit(name), "variant": F.lit(variant)})
            pools = rows if pools is None else pools.unionByName(rows)
    keys = ["method", "variant"]
    ranked = pool_ranks(pool_ranks(saved(pools), "bm25", "bm25_rank", True, keys), "dense", "dense_rank", False, keys)
    fused = ranked.withColumn("rrf", reciprocal("bm25_rank", k) + reciprocal("dense_rank", k))
    return ranked_at_scale(fused, keys, "position", F.desc("rrf"), F.col("id")).where(F.col("position") <= limit).select(*keys, "id", "from_graph", "bm25_rank", "dense_rank", "rrf", "position")


def fuse_lists(a: DataFrame, b: DataFrame, k: int = RRF_K, limit: int = 10) -> DataFrame:
    """Two ranked lists (id, rank) joined by a full outer join and fused."""
    both = a.select("id", F.col("rank").alias("rank_a")).join(b.select("id", F.col("rank").alias("rank_b")), "id", "full")
    return both.withColumn("rrf", reciprocal("rank_a", k) + reciprocal("rank_b", k)).orderBy(F.desc("rrf"), "id").limit(limit)


def best_chunk(chunks: DataFrame, owner: str, chunk: str, score: str) -> DataFrame:
    """(owner, score, chunk) of each owner's best chunk; ties to the smallest chunk id."""
    return chunks.groupBy(owner).agg(F.max(score).alias(score), F.min_by(chunk, F.struct(-F.col(score), F.col(chunk))).alias(chunk))


def graph_candidates(edges: DataFrame, owner: str, member: str, required: dict[str, list[str]], excluded: Sequence[str] = (), everything: DataFrame | None = None) -> DataFrame:
    """Owners with every required term and no excluded member; without conditions none, or all of ``everything``."""
    from .constraints import division, without

    if not required and not excluded:
        return everything.select(owner) if everything is not None else edges.select(owner).limit(0)
    found = division(edges, owner, member, required) if required else (everything if everything is not None else edges).select(owner).distinct()
    return without(found, edges, owner, member, excluded) if excluded else found


def covered(graph: DataFrame, scored: DataFrame) -> DataFrame:
    """One row: candidates, scored rows, and whether every candidate was scored."""
    ids = graph.select("id").distinct()
    counts = ids.join(scored.where("dense IS NOT NULL").select("id").distinct().withColumn("hit", F.lit(1)), "id", "left")
    return counts.agg(F.count("*").alias("graph_count"), F.coalesce(F.sum("hit"), F.lit(0)).alias("scored_count")).withColumn("complete", F.col("graph_count") == F.col("scored_count"))


def with_evidence(ranked: DataFrame, evidence: DataFrame, allowed: Column, limit: int) -> DataFrame:
    """The first ``limit`` of ranked(id, rank) that a filter over their evidence(id, ...) leaves; those without evidence stay, marked.

    The filter comes after the search and nothing refills it.
    """
    rows = ranked.join(evidence.withColumn("__known", F.lit(True)), "id", "left").withColumn("orphan", F.col("__known").isNull()).drop("__known")
    return rows.where(F.col("orphan") | F.coalesce(allowed, F.lit(False))).orderBy("rank").limit(limit)
