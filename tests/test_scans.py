"""Scans and alignments over one key that holds all rows: equal to plain loops, and no window over the whole key."""

import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators import audit, evidence, timeline
from graphloom.operators.scans import Ranges, plain


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [("hot", i, rng.choice([None, 0, 1, 2, 5, 9]), rng.randrange(0, 3000)) for i in range(2500)]
    out += [(k, 10_000 + i, rng.randrange(0, 9), rng.randrange(0, 50)) for i, k in enumerate(rng.choices(["a", "b", None], k=60))]
    rng.shuffle(out)
    return out


def by_key(rows, order=lambda r: r[1]):
    groups = {}
    for r in sorted(rows, key=order):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_sums_maxima_neighbours_numbers(spark, rows):
    df = spark.createDataFrame(rows, "k string, i long, v long, s long")
    ranges = Ranges(df, ["k"], F.col("i"), parts=16)
    assert ranges.rows.where("k = 'hot'").select("__part").distinct().count() > 8
    got = {}
    for name, made in (("upto", ranges.summed(F.col("v"), "x")), ("before", ranges.summed(F.col("v"), "x", False)), ("most", ranges.greatest(F.col("v"), "x")), ("most_before", ranges.greatest(F.col("v"), "x", False)), ("previous", ranges.neighbour(F.col("v"), "x")), ("next", ranges.neighbour(F.col("v"), "x", False)), ("number", ranges.numbered("x"))):
        got[name] = {r.i: r.x for r in plain(made).collect()}
        assert len(got[name]) == len(rows)
    for group in by_key(rows).values():
        total, most = 0, None
        for n, (_, i, v, _) in enumerate(group):
            assert got["before"][i] == total and got["most_before"][i] == most and got["number"][i] == n + 1
            total += v or 0
            most = v if most is None else most if v is None else max(most, v)
            assert got["upto"][i] == total and got["most"][i] == most
            assert got["previous"][i] == (group[n - 1][2] if n else None) and got["next"][i] == (group[n + 1][2] if n + 1 < len(group) else None)


def windows(df):
    """What each window of the plan is over: partition and order."""
    return re.findall(r"windowspecdefinition\(([^()]*)", df._jdf.queryExecution().optimizedPlan().toString())


def test_operators_on_one_key(spark, rows):
    rows = [(k, i, v or 0, s) for k, i, v, s in rows]
    df = spark.createDataFrame(rows, "k string, i long, v long, s long").withColumn("e", F.col("s") + F.col("v")).withColumn("t", F.repeat(F.lit("x"), F.col("v").cast("int")))
    by_start = lambda r: (r[3], r[1])
    found = evidence.islands(df, ["k"], "s", "e", F.lit(3), F.col("s"), F.col("i"))
    kept = evidence.within_budget(df, ["k"], "v", 700, F.col("i"))
    newest = evidence.newest_within(df, ["k"], "t", 701, F.desc("i"))
    gaps = audit.coverage_gaps(df.withColumn("length", F.lit(2600)), "k", "s", "e", "length")
    for made in (found, kept, newest, gaps):
        specs = windows(made)
        assert specs and all("__part" in x for x in specs)  # a key's range, or the ranges of a key: a row each
    island = {r.i: r.island for r in found.collect()}
    budget = {r.i: r.used for r in kept.collect()}
    last = {r.i: len(r.t) for r in newest.collect()}
    broken = {r.k: (r.n_gaps, r.n_overlaps, r.covered) for r in gaps.collect()}
    for key, group in by_key(rows, by_start).items():
        reach, n = None, 0
        for _, i, v, s in group:
            n += reach is None or s > reach + 3
            reach = s + v if reach is None else max(reach, s + v)
            assert island[i] == n
        before, n_gaps, n_overlaps = 0, 0, 0
        for _, i, v, s in sorted(group, key=lambda r: (r[3], r[3] + r[2])):
            n_gaps, n_overlaps, before = n_gaps + (s > before), n_overlaps + (s < before), s + v
        assert broken[key] == (n_gaps, n_overlaps, max(s + v for _, _, v, s in group))
    for group in by_key(rows).values():
        used = 0
        for _, i, v, _ in group:
            used += v
            assert budget.get(i) == (used if used <= 700 else None)
        used = 0
        for _, i, v, _ in reversed(group):
            room = 701 - used
            assert last.get(i) == (min(v, room) if room > 0 else None)
            used += v


def test_ties_have_one_order(spark):
    """Rows that tie keep their order from one scan of an operator to the next."""
    df = spark.createDataFrame([("a", 5 * (i // 40), 5 * (i // 40) + i % 3) for i in range(400)], "k string, s long, e long")
    found = evidence.islands(df, ["k"], "s", "e", F.lit(2), F.col("s"))
    assert {(r.s // 5, r.island) for r in found.collect()} == {(n, n + 1) for n in range(10)}


def aligned(spark, scores, parts):
    df = spark.createDataFrame(scores, "timeline string, media string, at long, step string, step_order long, score double")
    return sorted(tuple(r) for r in timeline.align_monotone(df, "timeline", 0.5, parts).collect())


def test_alignment_by_segments(spark):
    """The same assignment for any number of segments: ties in gain, in matches and in time, steps that are missing."""
    rng = random.Random(21)
    scores = []
    for t in range(12):
        at = 0
        for m in range(rng.choice([1, 30, 90])):
            at += rng.choice([0, 1, 1, 2])
            for k in rng.sample(range(6), rng.randrange(0, 5)):
                scores.append((f"t{t}", f"m{m}", at, f"s{k}", k, rng.choice([0.25, 0.5, 0.5, 0.75, 1.0, None])))
            scores.append((f"t{t}", f"m{m}", at, "s9", 9, None))
    want = aligned(spark, scores, 1)
    assert len(want) > 80
    for parts in (3, 17, 60):
        assert aligned(spark, scores, parts) == want


def test_long_timeline(spark):
    """Twenty thousand media in many segments: orders never fall, and the gain is that of a plain dynamic program."""
    rng = random.Random(5)
    scores = [("t", f"m{m:06d}", m, f"s{k}", k, rng.randrange(0, 101) / 100) for m in range(20_000) for k in range(3)]
    df = spark.createDataFrame(scores, "timeline string, media string, at long, step string, step_order long, score double")
    rows = timeline.align_monotone(df, "timeline", 0.5, 40).collect()
    orders = [int(r.step[1:]) for r in sorted(rows, key=lambda r: r.media)]
    assert orders == sorted(orders) and len({r.media for r in rows}) == len(rows)
    best = [0.0] * 3
    for m in range(20_000):
        here = [max(0.0, scores[3 * m + k][5] - 0.5) for k in range(3)]
        best = [max(best[: k + 1]) + here[k] for k in range(3)]
    assert abs(sum(r.score - 0.5 for r in rows) - max(best)) < 1e-6
