"""Rankings of stated queries over all vectors: odd vectors as in the SQL, blocks that do not matter, no joined pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.operators import rankings
from graphloom.plans.catalogue import ORACLES, QUERIES

from .oracle import TABLES, differences

#: Queries over these rankings.
BLOCKED = ["q_ablation_matrix", "q_rank_diff", "q_method_changes", "q_metric_audit", "q_mrr", "q_precision_recall", "q_ranking_audit", "q_missed_gold", "q_recall_ceiling"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Equal, opposite, empty, missing, short and partly null vectors, negative ids, missing labels."""
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)], int(rng.integers(0, 3))) for i in range(-120, 260)]
    rows = [(i, rows[7][1] if i % 9 == 0 else v, None if i % 31 == 0 else label) for i, v, label in rows]
    rows += [(300, [0.0] * 6, 1), (301, None, 1), (302, [1.0, 2.0], 2), (303, [0.0] * 6, 0), (304, [1.0, None, 2.0, 0.5, 0.1, 0.3], 0), (350, None, 2), (400, [3.0], 0), (450, [], 1), (500, [None, None], 1), (550, [1.0] * 6, 77)]
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    for t in set(TABLES) - {"embeddings"}:
        spark.range(1).write.parquet(f"{folder}/{t}.parquet")
    return folder


@pytest.mark.parametrize("name", BLOCKED)
def test_odd_vectors_as_in_the_sql(spark, odd, name, monkeypatch):
    assert differences(QUERIES[name](spark, odd), ORACLES[name], odd) is None
    for size in ("SHARD", "QUERIES", "BATCH", "PAIRS", "TASK"):
        monkeypatch.setattr(rankings, size, 5 if size in ("SHARD", "QUERIES") else 70)
    assert differences(QUERIES[name](spark, odd), ORACLES[name], odd) is None


@pytest.mark.parametrize("name", BLOCKED)
def test_pairs_are_not_joined(spark, name, capsys):
    QUERIES[name](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out
    assert "Plan" in plan and "zip_with" not in plan  # the cosine of a joined pair


def test_best_of_all_pairs(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(3000, 12)).astype(np.float32)
    x[500:900] = x[499]  # more equal vectors than are asked for
    rows = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(x)], "id long, v array<float>, label int")
    found = rankings.ranked(rows, "id", "v", "label", rows.where("id % 150 = 0"), {"a": F.lit(0.0), "b": (F.col("id") % 3) * 0.05}, 7).collect()
    y = x.astype(float)
    unit = y / np.linalg.norm(y, axis=1)[:, None]
    for q in range(0, 3000, 150):
        score = np.round(unit @ unit[q], 9)
        for way, less in (("a", 0), ("b", 0.05 * (np.arange(3000) % 3))):
            shifted = np.round(score - less, 9)
            want = [i for i in sorted(range(3000), key=lambda i: (-shifted[i], i)) if i != q][:7]
            got = sorted((r["rank"], r.id, r.relevant) for r in found if r.query_id == q and r.method == way)
            assert got == [(n + 1, i, i % 4 == q % 4) for n, i in enumerate(want)]
