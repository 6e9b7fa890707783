"""The k best texts of a lexical query from postings in order of impact, without reading all of them.

A posting's impact is what its term adds to a score before the term's weight. Postings lie in folders by bucket of
terms and level of impact, and a small table tells each term's blocks (a level of one term) with their greatest
impact. A search reads the blocks from the greatest on. As soon as what is unread could not lift any text that
was not met above the k-th score found, the search needs the full scores of only those that were met and may still be among the k.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import saved, ship_package
from .retrieval import K1, B, LexicalIndex

BUCKETS, LEVELS = 16, 12
#: Scores are rounded, so that equal ones tie whatever the order of their sums.
DIGITS = 9


def _postings(batches):
    """(id, length, term, tf) of tokenised texts."""
    for batch in batches:
        words = batch.column(1)
        names = words.flatten().dictionary_encode()
        length = np.diff(words.offsets.to_numpy())
        size = max(len(names.dictionary), 1)
        pairs, tf = np.unique(np.repeat(np.arange(len(batch)), length) * size + names.indices.to_numpy(), return_counts=True)
        row = pairs // size
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(length[row].astype(np.int64)), names.dictionary.take(pa.array(pairs % size)).cast(pa.string()), pa.array(tf)], names=["id", "length", "term", "tf"])


@dataclass
class Read:
    """How much of a query's postings a search has read, and what it looked up besides."""

    blocks: int
    of_blocks: int
    postings: int
    of_postings: int
    looked_up: int


class ImpactIndex:
    """An index that was built once; k1 and b are part of the impacts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        about = spark.read.schema("n long, id string").json(f"{self.path}/about").first()
        self.n_texts, self.id = about.n, about.id

    @classmethod
    def build(cls, docs: DataFrame, id_col: str, text_col: str, path: str, k1: float = K1, b: float = B) -> ImpactIndex:
        """Write the index of docs; an earlier one at the path is replaced. Texts are tokenised once."""
        spark, path = docs.sparkSession, path.rstrip("/")
        ship_package(spark)
        texts = LexicalIndex(docs, id_col, text_col).tokenised
        schema = T.StructType([texts.schema["id"], T.StructField("length", T.LongType()), T.StructField("term", T.StringType()), T.StructField("tf", T.LongType())])
        rows = saved(texts.where("size(words) > 0").mapInArrow(_postings, schema))
        whole, filled = docs.agg(F.count("*"), F.count(text_col)).first()  # the average length is that of texts that are not null
        average = (rows.agg(F.sum("tf")).first()[0] or 1) / max(filled, 1)
        impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.lit(float(average))))
        level = F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.floor((1 - F.col("impact") / (k1 + 1)) * LEVELS))).cast("int")
        bucket = F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int")
        rated = rows.select("id", "term", impact.alias("impact")).withColumns({"level": level, "bucket": bucket})
        # large folders are split and small ones put together by what their rows turn out to weigh
        rated.hint("rebalance", "bucket", "level").sortWithinPartitions("bucket", "level", "term").write.mode("overwrite").partitionBy("bucket", "level").parquet(f"{path}/postings")
        blocks = rated.groupBy("bucket", "term", "level").agg(F.count("*").alias("n"), F.max("impact").alias("greatest"))
        blocks.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/blocks")
        # the same by text: looked up by id, through the row groups' and pages' statistics
        by_text = rated.select("id", "term", "impact")
        by_text.repartitionByRange("id", "term").sortWithinPartitions("id", "term").write.mode("overwrite").parquet(f"{path}/texts_postings")
        spark.createDataFrame([(whole, rows.schema["id"].dataType.simpleString())], "n long, id string").coalesce(1).write.mode("overwrite").json(f"{path}/about")
        return cls(spark, path)

    def _table(self, name: str) -> DataFrame:
        columns = {"postings": f"id {self.id}, term string, impact double, bucket int, level int", "blocks": "term string, level int, n long, greatest double, bucket int", "texts_postings": f"id {self.id}, term string, impact double"}
        return self.spark.read.schema(columns[name]).parquet(f"{self.path}/{name}")

    def _buckets(self, terms: list[str]) -> list[int]:
        rows = self.spark.createDataFrame([(t,) for t in terms], "term string").select(F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int").alias("b")).distinct()
        return [r.b for r in rows.collect()]

    def top(self, query: Sequence[str], k: int = 50) -> tuple[DataFrame, Read]:
        """(id, bm25) of the k best texts with a term of the query, ties to the smaller id, as a full scan gives them."""
        terms = sorted(set(query))
        buckets = self._buckets(terms) if terms else []
        known = self._table("blocks").where(F.col("bucket").isin(buckets) & F.col("term").isin(terms)).collect()  # LEVELS rows for each term
        df = {t: sum(r.n for r in known if r.term == t) for t in terms}
        weight = {t: math.log1p((self.n_texts - df[t] + 0.5) / (df[t] + 0.5)) for t in terms if df[t]}
        blocks = sorted(((r.greatest * weight[r.term], r.term, r.level, r.n) for r in known), key=lambda x: -x[0])
        weights = F.create_map(*[F.lit(x) for t, w in weight.items() for x in (t, w)]) if weight else None
        met, at, least, share = None, 0, 0.0, 1.0
        unread = lambda: {t: max((x[0] for x in blocks[at:] if x[1] == t), default=0.0) for t in weight}
        while at < len(blocks):
            share /= 2  # each round reads what stands above half of the last bound, so there are few
            stop = at + 1
            while stop < len(blocks) and blocks[stop][0] > share * blocks[0][0]:
                stop += 1
            part = saved(self._read(blocks[at:stop], buckets, weights))
            met, at = part if met is None else met.unionByName(part), stop
            scores = met.groupBy("id").agg(F.sum("gain").alias("low"))
            best = [r.low for r in scores.orderBy(F.desc("low")).limit(k).collect()]  # k rows
            least = best[-1] if len(best) == k else 0.0
            if len(best) == k and sum(unread().values()) < least - 10.0**-DIGITS:
                break
        read = Read(at, len(blocks), sum(x[3] for x in blocks[:at]), sum(x[3] for x in blocks), 0)
        if met is None:
            return self._table("postings").select("id", F.lit(0.0).alias("bm25")).limit(0), read
        rest = unread()
        full = F.sum("gain").alias("low"), *[F.max((F.col("term") == t).cast("int")).alias(f"has{i}") for i, t in enumerate(rest)]
        high = F.col("low")
        for i, (_, bound) in enumerate(rest.items()):
            high = high + F.when(F.col(f"has{i}") == 0, bound).otherwise(0.0)
        may = saved(met.groupBy("id").agg(*full).where(high >= least - 10.0**-DIGITS).select("id", "low"))
        if at < len(blocks):
            read.looked_up = may.count()
            wanted = self._table("texts_postings").where(F.col("term").isin(terms))
            if read.looked_up <= 10_000:  # ids go into the scan's filter and skip row groups and pages
                wanted = wanted.where(F.col("id").isin([r.id for r in may.select("id").collect()]))
            else:
                wanted = wanted.join(may.select("id"), "id", "left_semi")
            may = wanted.groupBy("id").agg(F.sum(weights[F.col("term")] * F.col("impact")).alias("low"))
        return may.select("id", F.round("low", DIGITS).alias("bm25")).orderBy(F.desc("bm25"), "id").limit(k), read

    def _read(self, blocks: list[tuple], buckets: list[int], weights) -> DataFrame:
        """(id, term, gain) of some blocks; only the folders of their levels and buckets are read."""
        rows = self._table("postings").where(F.col("bucket").isin(buckets) & F.col("level").isin(sorted({x[2] for x in blocks})) & F.col("term").isin(sorted({x[1] for x in blocks})))
        chosen = F.lit(False)
        for term in sorted({x[1] for x in blocks}):
            chosen = chosen | ((F.col("term") == term) & F.col("level").isin([x[2] for x in blocks if x[1] == term]))
        return rows.where(chosen).select("id", "term", (weights[F.col("term")] * F.col("impact")).alias("gain"))
