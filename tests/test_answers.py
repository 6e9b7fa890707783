"""Whole answers, re-validated output, case metrics and progress: planted faults, nulls, repeated rows, empty tables."""

from graphloom.operators import guided, metrics, progress
from graphloom.operators.constraints import Constraints

CHOICES = "answer_id int, place int, recipe_id string, position int, step_id string, text string, citations array<string>"
STEPS = "recipe_id string, order int, step_id string, text string, source_id string"
EVIDENCE = "evidence_id string, kind string, recipe_id string, step_id string, source_id string"


def walk(spark, choices, limit=2):
    steps = [("a", 5, "a1", "Take 2 eggs", "s"), ("a", 9, "a2", "Stir", "s"), ("b", 1, "b1", "Boil 5", None)]
    evidence = [("E1", "step", "a", "a1", "s"), ("E2", "step", "a", "a2", "s"), ("E3", "step", "b", "b1", None), ("E4", "source", "a", "a1", "s"), ("E5", "step", "a", "a1", "other")]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    rows = guided.walk_violations(frame(choices, CHOICES), frame(steps, STEPS), frame(evidence, EVIDENCE), limit).collect()
    return sorted(((r.answer_id, r.place, r.position, r.reason) for r in rows), key=str)


def test_answers_that_tell_all_steps_in_order(spark):
    first, second, third = (1, 1, "a", 1, "a1", "取2个", ["E1"]), (1, 1, "a", 2, "a2", "搅", ["E2"]), (1, 2, "b", 1, "b1", "煮5", ["E3"])
    assert walk(spark, [first, second, third]) == []
    assert walk(spark, []) == []
    bad = [
        (2, 1, "a", 1, "a2", "搅", ["E2"]), (2, 1, "a", 2, "a1", "取2个", ["E1"]),  # swapped
        (3, 1, "a", 1, "a1", "取3个", ["E1", "E1"]), (3, 1, "a", 2, "a2", "stir", None),
        (4, 1, "a", 1, "a1", "取2个", ["E4", "E5", "E9", None]), (4, 1, "a", 2, "a2", None, ["E2"]), (4, 1, "a", 3, "a3", "完", ["E1"]),
        (5, 1, None, 1, "a1", "取", ["E1"]), (5, 2, "b", 1, "b1", "煮" * 4001, ["E3"]), (5, 3, "b", 1, "b1", "煮", ["E3"]),
        (6, 1, "a", 2, "a2", "搅", [f"E{i}" for i in range(9)]),
        (7, 1, "a", 1, "a1", "取2个", ["E1"]), (7, 1, "a", 1, "a1", "取2个", ["E1"]),
    ]
    assert walk(spark, bad) == sorted(
        [
            (2, 1, 1, "reordered_step"), (2, 1, 2, "reordered_step"), (2, 1, 1, "citation_source"), (2, 1, 2, "citation_source"), (2, 1, 2, "unsupported_number"),
            (3, 1, 1, "unsupported_number"), (3, 1, 1, "citations"), (3, 1, 2, "text"), (3, 1, 2, "citations"),
            (4, 1, 1, "citation_source"), (4, 1, 1, "unknown_citation"), (4, 1, 2, "text"), (4, 1, 3, "reordered_step"), (4, 1, None, "incomplete_steps"),
            (5, 1, 1, "reordered_step"), (5, 1, None, "unknown_recipe"), (5, 2, 1, "text"), (5, 2, None, "repeated_recipe"), (5, 3, None, "repeated_recipe"), (5, None, None, "recipe_count"),
            (6, 1, 2, "citations"), (6, 1, 2, "unknown_citation"), (6, 1, 2, "citation_source"), (6, 1, None, "incomplete_steps"),
            (7, 1, None, "incomplete_steps"),
        ],
        key=str,
    )


def test_output_is_checked_once_more(spark):
    recommended = spark.createDataFrame([(1, "a", ["s"], ["egg"], 5.0, ["E1"]), (1, "b", ["s"], ["egg"], 5.0, None), (1, "none", ["s"], None, None, ["E2"]), (2, "a", ["t"], ["egg"], None, ["E1", None])], "question int, recipe_id string, steps array<string>, members array<string>, minutes double, evidence_ids array<string>")
    candidates = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "a")], "question int, recipe_id string")
    facts = spark.createDataFrame([("a", ["s"], ["egg"], [], 5.0, ["quick"], "A"), ("b", ["s"], ["egg"], ["nut"], 5.0, ["quick"], "B")], "recipe_id string, steps array<string>, members array<string>, extras array<string>, minutes double, tags array<string>, name string")
    evidence = spark.createDataFrame([(1, "E1"), (2, "E1")], "question int, evidence_id string")
    found = guided.output_violations(recommended, candidates, facts, evidence, Constraints(excluded=("nut",), at_most=5.0, required_tags=("quick",), allow_missing=True)).collect()
    assert sorted((r.question, r.recipe_id, r.reason) for r in found) == [(1, "b", "demands"), (1, "none", "candidate"), (1, "none", "demands"), (1, "none", "details"), (1, "none", "evidence"), (2, "a", "details"), (2, "a", "evidence")]


def test_cases_by_kind(spark):
    cases = spark.createDataFrame([(1, "x", "ok", ["a", "b"]), (2, "x", "ok", None), (3, "y", "ok", ["a"]), (4, None, "ok", [])], "case_id int, kind string, status string, ids array<string>")
    results = spark.createDataFrame([(1, "ok", ["b", "a", "a"], ["a"], 1, True, 4.0), (2, "ok", [], None, 3, True, 8.0), (3, "ok", ["a"], ["a", "z"], 3, True, None)], "case_id int, status string, candidate_ids array<string>, recommended_ids array<string>, top_k int, valid boolean, ms double")
    got = {r.kind: tuple(r)[1:] for r in metrics.functional(cases, results).collect()}
    assert got == {"x": (2, 2, 1.0, 1.0, 6.0), "y": (1, 0, 0.0, 1.0, None), None: (1, 0, 0.0, 0.0, None), "all": (4, 2, 0.5, 0.75, 6.0)}
    assert metrics.functional(cases.limit(0), results).count() == 0


EXPECTED = "item string, images long, videos long, media_ids array<string>"
ITEMS = "item string, status string, run_id string, images long, videos long, clips long, frames long, observations long, aligned long, nodes long, edges long, observation_ids array<string>"
HELD = "run_id string, media_ids array<string>, clips long, frames long, observations long, aligned long, nodes long, edges long"


def test_states_of_items(spark):
    expected = spark.createDataFrame([(i, 1, 1, ["m", "v"]) for i in ("fine", "twice", "ids", "still", "none", "failed", "less")] + [(None, 0, 0, None)], EXPECTED)
    good = lambda i, run, status="verified", **v: tuple({**dict(item=i, status=status, run_id=run, images=1, videos=1, clips=2, frames=2, observations=3, aligned=3, nodes=9, edges=8, observation_ids=["1", "2", "3"]), **v}.values())
    items = [good("fine", "r1"), good("twice", "r2"), good("twice", "r3"), good("ids", "r4", observation_ids=["1", "1", ""]), good("none", "r5", status=None), good("failed", None, status="failed"), good("less", "r6", clips=0, frames=-1, observations=1, observation_ids=["1"]), good("other", "r7"), good(None, "r8")]
    held = [(r, ["v", "m", "m"], 2, 2, 3, 3, 9, 8) for r in ("r1", "r2", "r3", "r4", "r7", "r9")]
    states = progress.item_states(expected, spark.createDataFrame(items, ITEMS), spark.createDataFrame(held, HELD))
    assert sorted((r.item, r.state, ",".join(r.reasons)) for r in states.collect()) == sorted([
        ("fine", "verified", ""), ("twice", "inconsistent", "repeated"), ("twice", "inconsistent", "repeated"), ("ids", "inconsistent", "observation_ids"), ("still", "pending", ""), ("none", "pending", ""), ("failed", "failed", ""),
        ("less", "inconsistent", "counts,aligned,windows,graph,graph_media"), ("other", "unexpected", ""), ("run:r9", "unexpected", ""),
    ])
    claimed = spark.createDataFrame([("verified", 1), ("failed", 2), ("else", 3), ("complete", 0), ("complete", 1)], "name string, n long")
    got = {r.name: (r.claimed, r.found, r.agrees) for r in progress.scope_progress(states, expected, claimed).collect()}
    assert got["verified"] == (1, 1, True) and got["failed"] == (2, 1, False) and got["else"] == (3, None, False) and got["complete"] == (1, 0, False)
    assert got["expected"] == (None, 7, False)
    assert got["images"] == (None, 1, False) and got["unexpected"] == (None, 2, False)
    empty = expected.limit(0), spark.createDataFrame([], ITEMS), spark.createDataFrame([], HELD)
    assert progress.item_states(*empty).count() == 0
    assert {r.name: r.found for r in progress.scope_progress(progress.item_states(*empty), empty[0], claimed).collect()}["complete"] == 1
