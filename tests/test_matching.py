"""Passages and names in texts: equal to looking for each in each, without a join and whatever is frequent."""

import random
import re
from collections import Counter

import pytest

from graphloom.operators import bundles, matching


@pytest.mark.parametrize("shard_bytes", [1 << 20, 60])
def test_passages_in_texts(spark, shard_bytes):
    rng = random.Random(9)
    word = lambda: rng.choice(["the", "the", "of", "a", "bee", "sea", "deep", "x%d" % rng.randrange(30)])
    texts = [(i, "  ".join(word() for _ in range(rng.randrange(0, 40))).title()) for i in range(80)] + [(80, None), (81, ""), (82, "the the the"), (82, "the the the")]
    passages = [(i, " ".join(word() for _ in range(rng.randrange(1, 6)))) for i in range(60)] + [(60, None), (61, ""), (62, " \t"), (63, "THE  the"), (63, "the the"), (64, "ea deep x"), (65, "nowhere at all found")]
    df, ps = spark.createDataFrame(texts, "doc long, text string"), spark.createDataFrame(passages, "item long, p string")
    found = matching.contained(ps, "item", "p", df, "doc", "text", shard_bytes)
    squeeze = lambda t: re.sub(r"\s+", " ", t.lower()).strip()
    want = Counter((i, d) for i, p in passages for d, t in texts if p is not None and t is not None and squeeze(p) in squeeze(t))
    assert Counter((r.item, r.doc) for r in found.collect()) == want and len(want) > 300
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_names_in_texts(spark):
    """A hundred thousand aliases, many beginning with one frequent word; ideographs also inside of words."""
    rng = random.Random(10)
    aliases = [(f"e{i}", f"the {rng.randrange(10**6)} thing") for i in range(100_000)] + [("fish", "the fish"), ("tofu", "豆腐"), ("none", None), ("salt", "Salt"), ("salt2", "salt")]
    texts = [(i, f"the {a[1][4:]} and the rest") for i, a in enumerate(aliases[:50])] + [(100, "The-fish, and the"), (101, "the fishes"), (102, "麻婆豆腐好"), (103, None), (104, "no salt's here; SALT")]
    df = spark.createDataFrame(texts, "id long, text string").repartition(4)
    entities = spark.createDataFrame(aliases, "entity_id string, alias string")
    got = {(r.id, r.entity_id) for r in bundles.entity_candidates(df, "id", ["text"], entities).collect()}
    owners = {}
    for e, a in aliases[:100_000]:
        owners.setdefault(a, []).append(e)
    want = {(i, e) for i in range(50) for e in owners[aliases[i][1]]} | {(100, "fish"), (102, "tofu"), (104, "salt"), (104, "salt2")}
    assert got == want


def test_passages_that_repeat(spark, monkeypatch):
    """One word is the passage of very many rows: what leaves a task at once, and what goes out at once, stays small."""
    monkeypatch.setattr(matching, "PAIRS", 1000)
    monkeypatch.setattr(matching, "BLOCK", 64)
    sizes = [len(at) for at, _ in matching._pairs({"a": list(range(50)), "b": [3], "c": list(range(2000))}, {"a": (0, 900), "b": (900, 901), "c": (901, 902)})]
    assert sum(sizes) == 50 * 900 + 1 + 2000 and max(sizes) <= 2000
    monkeypatch.setattr(matching, "ROWS", 700)
    passages = spark.range(3000).selectExpr("id AS item", "concat('w', id % 3) AS p")
    texts = spark.createDataFrame([(i, f"xw{i % 4}y z") for i in range(40)], "doc long, text string")
    got = Counter((r.item, r.doc) for r in matching.contained(passages, "item", "p", texts, "doc", "text").collect())
    assert got == Counter((i, d) for i in range(3000) for d in range(40) if i % 3 == d % 4)
