import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom.operators import audit, chunking, constraints, evidence, graph, mentions, metrics, retrieval, timeline


def test_null_bounds_and_tags(spark):
    df = spark.createDataFrame([(1, 10, ["a"]), (2, None, None), (3, 30, ["a", "b"])], "id int, minutes int, tags array<string>")
    ids = lambda test: [r.id for r in df.where(test).orderBy("id").collect()]
    assert ids(constraints.at_most(F.col("minutes"), 20)) == [1]
    assert ids(constraints.at_most(F.col("minutes"), None)) == [1, 2, 3]
    assert ids(constraints.has_all(F.col("tags"), ("a",))) == [1, 3] and ids(constraints.has_all(F.col("tags"), ())) == [1, 2, 3]


def test_eligible_and_rank(spark):
    rows = [("r1", "soup", ["egg"], ["salt"], 10, []), ("r2", "pie", ["egg", "flour"], [], None, []), ("r3", "egg pie", ["egg"], [], 5, [])]
    df = spark.createDataFrame(rows, "id string, name string, members array<string>, extras array<string>, value int, tags array<string>")
    at = {k: F.col(k) for k in ("members", "extras", "value", "tags", "name")}
    ids = lambda c: [r.id for r in constraints.ranked(df.where(constraints.eligible(c, **at)), c, "members", "value", "id").collect()]
    assert ids(constraints.Constraints(("egg",))) == ["r3", "r1"]
    assert ids(constraints.Constraints(("egg",), excluded=("salt",))) == ["r3"]  # seasonings count
    assert ids(constraints.Constraints(("egg",), allow_missing=True)) == ["r3", "r1", "r2"]
    assert ids(constraints.Constraints(name_part="pie")) == ["r3", "r2"]  # a name alone asks no inventory


def test_graph_owner_and_conflicts(spark):
    items = spark.createDataFrame([("m1", "f1"), ("m2", "f1"), ("m3", "f2"), ("m4", "f3")], "member string, folder string")
    owners = spark.createDataFrame([("m1", "f1", "A"), ("x", "f2", "B"), ("y", "f2", "C")], "member string, folder string, owner string")
    got = {r.member: (r.owner, r.method) for r in graph.unique_owner(items, owners, "member", "folder", "owner").collect()}
    assert got == {"m1": ("A", "exact"), "m2": ("A", "group"), "m3": (None, "none"), "m4": (None, "none")}


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([("a", "tofu tofu rice"), ("b", "tofu"), ("c", "rice")], "id string, text string")
    index = retrieval.LexicalIndex(docs, "id", "text")
    got = {r.id: r.bm25 for r in index.scores(["tofu", "tofu"]).collect()}
    idf, avg = math.log1p((3 - 2 + 0.5) / (2 + 0.5)), 5 / 3
    score = lambda tf, n: idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n / avg))
    assert got["c"] == 0 and math.isclose(got["a"], score(2, 3)) and math.isclose(got["b"], score(1, 1))
    assert {r.bm25 for r in index.scores([]).collect()} == {0.0}


def test_rrf_ranks_anew_inside_the_pool(spark):
    frame = lambda name, rows: spark.createDataFrame(rows, f"id string, {name} double")
    lexical = frame("bm25", [("a", 3.0), ("b", 2.0), ("c", 0.0)])
    dense = frame("dense", [("a", 0.1), ("b", 0.9), ("z", 1.0)])
    graph_ids = spark.createDataFrame([("c",), ("g",)], "id string")
    eligible = spark.createDataFrame([("b",), ("c",), ("g",)], "id string")
    got = {r.id: r for r in retrieval.pool_rrf(lexical, dense, graph_ids, eligible).collect()}
    assert set(got) == {"b", "c", "g"} and (got["b"].bm25_rank, got["b"].dense_rank) == (1, 1)
    assert got["c"].bm25_rank is None and got["c"].rrf == 0 and got["g"].position == 3
    few = retrieval.pool_rrf(lexical, dense, graph_ids.limit(0), eligible, seeds_each=1).collect()
    assert few == []  # the filter comes after the seeds and nothing refills them


def test_graph_candidates_without_conditions(spark):
    edges = spark.createDataFrame([("r1", "egg"), ("r1", "rice"), ("r2", "egg")], "owner string, member string")
    ids = lambda df: sorted(r.owner for r in df.collect())
    assert ids(retrieval.graph_candidates(edges, "owner", "member", {})) == []
    every = edges.select("owner").distinct()
    assert ids(retrieval.graph_candidates(edges, "owner", "member", {}, everything=every)) == ["r1", "r2"]
    assert ids(retrieval.graph_candidates(edges, "owner", "member", {"e": ["egg", "eggs"]}, ["rice"])) == ["r2"]


def test_metrics_by_hand(spark):
    ranks = spark.createDataFrame([("q", "a", 1), ("q", "b", 2)], "query_id string, id string, rank int")
    gold = spark.createDataFrame([("q", "b"), ("q", "x"), ("q", "b"), ("n", "y")], "query_id string, id string")
    got = {r.query_id: r for r in metrics.per_query(ranks, gold, 5).collect()}
    assert (got["q"].precision, got["q"].recall, got["q"].returned_precision, got["q"].rr) == (0.2, 0.5, 0.5, 0.5)
    assert (got["n"].precision, got["n"].hit, got["n"].rr) == (0, 0, 0)


def test_mentions():
    table = mentions.lexicon([("ingredient", "soy sauce", []), ("ingredient", "sauce", []), ("tool", "sauce pan", []), ("action", "pan", []), ("ingredient", "berry", [])])
    found = mentions.find("\U0001f600 Soy sauce, berries in the Sauce  pan for 3-5 minutes at -18 °C", table.patterns())
    assert [(k, n, norm) for k, n, norm, *_ in found] == [("ingredient", "Soy sauce", "soy sauce"), ("ingredient", "berries", "berry"), ("tool", "Sauce  pan", "sauce pan"), ("duration", "3-5 minutes", "3-5 minutes"), ("temperature", "-18 °C", "-18 °c")]
    assert found[0][4:] == (2, 11)
    with pytest.raises(mentions.LexiconConflict):
        mentions.lexicon([("tool", "pan", []), ("tool", "wok", ["pan"])])


def test_mention_rules():
    table = mentions.lexicon([
        ("tool", "whisk", []), ("tool", "knife", []), ("tool", "rice cooker", []), ("tool", "mixing bowl", []), ("ingredient", "tomato", []), ("ingredient", "bay leaf", []), ("ingredient", "rice", []),
        ("ingredient", "egg", []), ("ingredient", "baking powder", []), ("action", "whisk", ["whisking"]), ("action", "stir fry", ["stir-frying"]), ("action", "bake", ["baking"]), ("action", "mix", ["mixing"]),
    ])
    kinds = lambda t, kind: [m[2] for m in mentions.find(t, table.patterns()) if m[0] == kind]
    assert kinds("Whisk eggs with a whisk.", "tool") == ["whisk"] and kinds("Whisk eggs with a whisk.", "action") == ["whisk"]
    assert kinds("Whisk tomatoes and bay leaves with knives", "ingredient") == ["tomato", "bay leaf"]
    assert kinds("Whisk tomatoes and bay leaves with knives", "tool") == ["knife"]
    text = "Stir–fry rice, add baking powder to a mixing bowl in the rice cooker"
    assert (kinds(text, "action"), kinds(text, "ingredient"), kinds(text, "tool")) == (["stir fry"], ["rice", "baking powder"], ["mixing bowl", "rice cooker"])
    words = lambda t, kind: [m[1] for m in mentions.find(t, table.patterns()) if m[0] == kind]
    assert words("for half an hour or overnight, 1 1/2 hours, ½ hour, 10 to 15 minutes, an hour", "duration") == ["half an hour", "overnight", "1 1/2 hours", "½ hour", "10 to 15 minutes", "an hour"]
    assert words("Heat to 350°F, 180 degrees Celsius, 180 Celsius, -10°C; turn 180 degrees, 350 grams", "temperature") == ["350°F", "180 degrees Celsius", "180 Celsius", "-10°C"]


def test_lexicon_files(folder):
    import json
    import os

    path = os.path.join(folder, "lexicon.json")

    def load(raw, base=None):
        with open(path, "w", encoding="utf-8") as file:
            json.dump(raw, file)
        return mentions.load_lexicon(path, base)

    base = mentions.lexicon([("ingredient", "tomato", [], "番茄"), ("ingredient", "soursop", [])])
    table = load({"ingredients": [{"normalized_name": "soursop", "zh_name": "刺果番荔枝", "aliases": ["guanabana"]}]}, base)
    assert [(m[2], m[3]) for m in mentions.find("Mix guanabana, soursops and tomatoes", table.patterns())] == [("soursop", "刺果番荔枝"), ("soursop", "刺果番荔枝"), ("tomato", "番茄")]
    literal = load({"ingredients": [{"normalized_name": "literal", "aliases": ["milk.*"]}]})
    assert mentions.find("milk powder", literal.patterns()) == [] and [m[2] for m in mentions.find("milk.* ", literal.patterns())] in ([], ["literal"])
    for wrong in ({"foods": []}, {"tools": [{"normalized_name": " "}]}, {"tools": [{"normalized_name": "x", "more": 1}]}, {"tools": {}}):
        with pytest.raises(ValueError):
            load(wrong)
    with pytest.raises(mentions.LexiconConflict):
        load({"tools": [{"normalized_name": "pan"}, {"normalized_name": "wok", "aliases": ["pan"]}]})


def test_windows_and_frames(spark):
    media = spark.createDataFrame([("v", 12.0), ("w", 0.0)], "m string, seconds double")
    clips = timeline.clip_windows(media, "m", "seconds")
    assert sorted((r.start, r.end) for r in clips.collect()) == [(0, 5), (5, 10), (10, 12)]
    frames = spark.createDataFrame([("v", float(t)) for t in range(12)], "m string, at double")
    near = timeline.nearest_frames(clips, frames, "m", "at").collect()
    assert sorted(r["at"] for r in near if r.clip == 0) == [2, 3, 1] or sorted(r["at"] for r in near if r.clip == 0) == [1, 2, 3]
    assert sorted(r["at"] for r in near if r.clip == 2) == [10, 11]


def test_range_join(spark):
    points = spark.createDataFrame([("k", 5.0), ("k", 9.9), ("j", 5.0)], "k string, at double")
    ranges = spark.createDataFrame([("k", 0.0, 5.0), ("k", 4.0, 30.0)], "k string, lo double, hi double")
    got = sorted((r["at"], r.lo) for r in timeline.in_ranges(points, ranges, "k", "at", "lo", "hi", 4.0).collect())
    assert got == [(5.0, 0.0), (5.0, 4.0), (9.9, 4.0)]


def test_alignment_by_enumeration(spark):
    rng = random.Random(11)
    rows = []
    for line in range(12):
        for m in range(4):
            for s in range(3):
                rows.append((line, f"m{m}", rng.choice([0, 1, 1, 2]) + m // 2, f"s{s}", s, rng.choice([0.2, 0.4, 0.6, 0.8])))
    fixed = {}
    rows = [(line, m, fixed.setdefault((line, m), at), s, o, x) for line, m, at, s, o, x in rows]
    df = spark.createDataFrame(rows, "line long, media string, at long, step string, step_order long, score double")
    got = {}
    for r in timeline.align_monotone(df, "line", 0.5).collect():
        got.setdefault(r.line, {})[r.media] = r.score
    for line in range(12):
        own = [r for r in rows if r[0] == line]
        media = sorted({(r[2], r[1]) for r in own})
        best = (0.0, 0)
        for choice in itertools.product([None, 0, 1, 2], repeat=len(media)):
            picked = [(at, c, next(r[5] for r in own if r[1] == m and r[4] == c)) for (at, m), c in zip(media, choice) if c is not None]
            if any(x < 0.5 for *_, x in picked) or any(a[0] < b[0] and a[1] > b[1] for a in picked for b in picked):
                continue
            best = max(best, (round(sum(x - 0.5 for *_, x in picked), 9), len(picked)))
        mine = got.get(line, {})
        assert (round(sum(x - 0.5 for x in mine.values()), 9), len(mine)) == best


def test_chunks_are_lossless(spark):
    rows = [(1, i, " ".join(f"w{i}{j}" for j in range(n))) for i, n in enumerate([3, 3, 3, 3, 25, 1])] + [(2, 0, "")]
    steps = spark.createDataFrame(rows, "doc long, step long, body string")
    got = chunking.pack_steps(steps, "doc", "step", "body", 10, 3).collect()
    sizes = {}
    for r in got:
        sizes.setdefault((r.doc, r.chunk), []).append(r.n_tokens)
    assert all(sum(v) <= 10 and len(v) <= 3 for v in sizes.values())
    text = {(d, s): b for d, s, b in rows}
    for key, body in text.items():
        parts = sorted((r.span_start, r.span_end) for r in got if (r.doc, r.step) == key)
        assert "".join(body[a:b] for a, b in parts) == body and all(x[1] == y[0] for x, y in zip(parts, parts[1:]))


def test_budget_stops_at_the_first_breach(spark):
    df = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 1)], "k int, n int, size int")
    assert [r.n for r in evidence.within_budget(df, ["k"], "size", 10, F.col("n")).collect()] == [1]


def test_selection_in_listed_order(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = evidence.in_listed_order(df, "id", ["c", "a"]).orderBy("position").collect()
    assert [r.id for r in got] == ["c", "a"]
    for wrong in (["a", "a"], ["a", "x"]):
        with pytest.raises(ValueError):
            evidence.in_listed_order(df, "id", wrong)


def test_audits(spark):
    parts = spark.createDataFrame([("a", 0, 3, 5), ("a", 3, 5, 5), ("b", 0, 2, 4), ("c", 0, 3, 4), ("c", 2, 4, 4)], "k string, s int, e int, n int")
    assert sorted(r.k for r in audit.coverage_gaps(parts, "k", "s", "e", "n").collect()) == ["b", "c"]
    ids = spark.createDataFrame([(1,), (2,), (2,), (None,)], "i int")
    assert sorted((r.i or 0) for r in audit.duplicates(ids, ["i"]).collect()) == [0, 2]
    edges = spark.createDataFrame([("n1", "r1", "IN"), ("r1", "n1", "IN"), ("n1", "zz", "IN")], "start_id string, end_id string, type string")
    nodes = spark.createDataFrame([("n1", "nation", "x"), ("r1", "region", "y")], "id string, label string, name string")
    assert graph.endpoint_violations(nodes, edges, [("IN", "nation", "region")]).count() == 2


def test_equal_pieces_for_any_counter():
    words = "".join(f"w{i} " + " " * (i % 3) for i in range(200))
    assert chunking.word_cuts(words, 7) == chunking.counted_cuts(words, 7, chunking.count_words) or all(n <= 7 for *_, n in chunking.word_cuts(words, 7))
    for text in (words, "x" * 500, "", "a b"):
        for cuts in (chunking.word_cuts(text, 7), chunking.counted_cuts(text, 7, chunking.count_words), chunking.counted_cuts(text, 7, len)):
            assert "".join(text[a:b] for a, b, _ in cuts) == text and all(n <= 7 or n == 1 for *_, n in cuts)


@pytest.mark.parametrize("use", ["candidates", "scope"])
def test_mentions_are_made_once(spark, use):
    """A graph of texts is used by several joins; what its texts mention is made once, and the rows are right."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    records = spark.createDataFrame([("a", "A"), ("b", "B"), ("bare", "C")], "record string, title string")
    steps = spark.createDataFrame([("a", 0, "cut leek"), ("a", 1, "cut"), ("b", 0, "leek, Leek"), ("bare", 0, "rest")], "record string, step int, text string")
    told = [("a", 0, "action", "cut"), ("a", 0, "ingredient", "leek"), ("a", 1, "action", "cut"), ("b", 0, "ingredient", "leek"), ("b", 0, "ingredient", "leek"), ("b", 0, "duration", "1 h")]
    found = spark.createDataFrame(told, "record string, step int, kind string, normalized_name string").mapInArrow(counted, "record string, step int, kind string, normalized_name string")
    nodes, edges = graph.text_graph(records, steps, found, {"action": "DOES", "ingredient": "USES"})
    if use == "candidates":
        names = {r.id: r.name for r in nodes.where("label = 'Record'").collect()}
        got = sorted((names[r.owner], r.kind, r.name) for r in graph.candidate_index(nodes, edges, "Record", "HAS_STEP").collect())
        assert got == [("A", "Action", "cut"), ("A", "Ingredient", "leek"), ("B", "Ingredient", "leek")]
    else:
        row = audit.scope_proof(nodes, edges, nodes.where("label = 'Record'"), "id").first()
        assert (row.missing, row.unexpected, row.loose_edges, row.complete) == (0, 6, 0, False)
    assert made.value == len(told)


def test_aliases_by_letter_find_the_same():
    rng = random.Random(4)
    aliases = sorted({"".join(rng.choices("abk", k=rng.randrange(1, 4))) + rng.choice(["", " a", " b"]) for _ in range(40)})
    table = mentions.lexicon([("action", a, []) for a in aliases])
    flat = re.compile(rf"(?<![A-Za-z0-9_])(?:{table.alternatives('action')})(?![A-Za-z0-9_])", re.IGNORECASE)
    for _ in range(300):
        text = "".join(rng.choices("abkABKK -_.", k=40))
        assert [m.span() for m in flat.finditer(text)] == [m.span() for m in table.patterns()[0][1].finditer(text)]


@pytest.mark.parametrize("few", [0, 100])
def test_scope_counts_loose_edges(spark, few, monkeypatch):
    monkeypatch.setattr(audit, "FEW", few)
    nodes = spark.createDataFrame([("a",), ("b",), ("b",)], "id string")
    edges = spark.createDataFrame([("a", "b", "T"), ("a", "x", "T"), ("a", "x", "T"), ("x", "y", "T"), ("y", "b", "U"), (None, "b", "U")], "start_id string, end_id string, type string")
    row = audit.scope_proof(nodes, edges, spark.createDataFrame([("a",), ("c",)], "id string"), "id").first()
    assert (row.missing, row.unexpected, row.loose_edges, row.complete) == (1, 1, 4, False)
