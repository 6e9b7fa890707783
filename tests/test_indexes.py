"""Inverted files of vectors and postings by impact: exact where they say so, with fewer reads."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators.impact_index import ImpactIndex
from graphloom.operators.retrieval import LexicalIndex
from graphloom.operators.vector_index import VectorIndex, unit_rows


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 16))
    x = middle[rng.integers(0, 40, 4000)] + 0.25 * rng.normal(size=(4000, 16))
    x[100:105] = x[99]  # equal vectors
    return x


def brute(x, ids, q, k):
    score = np.round((x @ q) / np.linalg.norm(x, axis=1) / np.linalg.norm(q), 9)
    order = sorted(range(len(x)), key=lambda i: (-score[i], ids[i]))[:k]
    return [(ids[i], float(score[i])) for i in order]


def test_vectors_in_lists(spark, folder, clustered):
    rows = [(i, v.tolist()) for i, v in enumerate(clustered)] + [(9000, None), (9001, [0.0] * 16), (9002, [1.0]), (9003, [float("nan")] * 16)]
    table = spark.createDataFrame(rows, "id long, v array<double>")
    index = VectorIndex.build(table, "id", "v", folder)
    assert index.vectors().count() == 4000 and sum(index.sizes) == 4000
    queries = table.where("id % 200 = 0 OR id = 99 OR id > 8999").select("id", F.col("v").alias("vector"))
    probes = index.probes_for(queries, 10, 0.95)
    assert probes <= len(index.lists) // 4
    row = index.recall(queries, 10, probes).first()
    assert row.recall >= 0.95 and row.n_queries == 21 and row.read <= 0.25
    ids = list(range(4000))
    exact = {}
    for r in index.search_all(queries, 10, None).collect():
        exact.setdefault(r.query, []).append((r["rank"], r.id, r.score))
    for i in [0, 99, 200, 3800]:
        want = brute(clustered, ids, clustered[i], 10)
        assert [(b, c) for _, b, c in sorted(exact[i])] == want
        assert [(r.id, r.score) for r in index.search(clustered[i], 10, 2, exact=True).collect()] == want
        assert len(index.reachable(clustered[i], want[-1][1])) < len(index.lists)
    assert set(exact) == {*range(0, 4000, 200), 99}  # vectors without length have no neighbours
    plan = index.search(clustered[0], 10, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan
    near = index.probed(clustered[0], 2, 10)
    found = {r.id for r in index.search(clustered[0], 10, 2).collect()}
    assert found <= {r.id for r in index.vectors().where(F.col("list").isin([index.lists[i] for i in near])).collect()}
    assert index.search([0.0] * 16, 10, exact=True).count() == 0


def test_blocks_of_vectors_do_not_matter(spark, folder, clustered, monkeypatch):
    from graphloom.operators import vector_index

    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clustered[:600])], "id long, v array<double>")
    queries = table.where("id < 60").select("id", F.col("v").alias("vector"))
    index = VectorIndex.build(table, "id", "v", folder, n_lists=3)
    want = sorted(map(tuple, index.search_all(queries, 7, None).collect()))
    monkeypatch.setattr(vector_index, "BLOCK", 37)
    monkeypatch.setattr(vector_index, "QUERIES", 11)
    assert sorted(map(tuple, index.search_all(queries, 7, None).collect())) == want and len(want) == 60 * 7
    empty = VectorIndex.build(table.limit(0), "id", "v", f"{folder}/none")
    assert empty.search([1.0] * 16).count() == 0 and empty.search_all(queries, 3).count() == 0


def test_unit_rows():
    import pyarrow as pa

    rows, good = unit_rows(pa.array([[3, 4], None, [0, 0], [1], [float("inf"), 1], [0, -2]], pa.list_(pa.float32())))
    assert good.tolist() == [True, False, False, False, False, True] and np.allclose(rows[[0, 5]], [[0.6, 0.8], [0, -1]])


def test_best_texts_without_reading_all(spark, folder):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    texts = [(i, " ".join(rng.choices(words, weights, k=rng.randrange(1, 120)))) for i in range(3000)]
    texts += [(3000 + i, texts[7][1]) for i in range(5)] + [(4000, None), (4001, ""), (4002, "w250 " * 3), (4003, "w0")]
    df = spark.createDataFrame(texts, "id long, text string")
    index = ImpactIndex.build(df, "id", "text", folder)
    full = LexicalIndex(df, "id", "text")
    fewer = 0
    for query, k in ((["w0", "w1"], 50), (["w250", "w0", "w0"], 5), (["w200"], 10), (["w3", "w40", "w120", "w299"], 20), (["w5", "unknown"], 3), (["unknown"], 3), ([], 3), (["w1"], 100_000)):
        found, read = index.top(query, k)
        scores = full.scores(query).select("id", F.round("bm25", 9).alias("bm25")).where("bm25 > 0").orderBy(F.desc("bm25"), "id").limit(k)
        assert [tuple(r) for r in found.collect()] == [tuple(r) for r in scores.collect()], query
        assert read.blocks <= read.of_blocks and read.postings <= read.of_postings
        fewer += read.postings < read.of_postings
        if read.blocks < read.of_blocks:
            assert 0 < read.looked_up < 3000
    assert fewer >= 3
    empty = ImpactIndex.build(df.limit(0), "id", "text", f"{folder}/none")
    assert empty.top(["w0"])[0].count() == 0
