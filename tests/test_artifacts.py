"""The audit of a whole graph: one small graph many times, each copy with one fault."""

import copy
import hashlib
import json
import re

from graphloom.operators import artifacts

SCOPE = {"split": "test", "dataset_revision": "v1"}
COLUMNS = {
    "members": "archive string, member string, kind string, size long, compressed_size long, crc32 long",
    "texts": "archive string, member string, sha256 string, text string",
    "recipes": "id string, archive string, folder string, title string, steps_member string, n_steps long",
    "media": "archive string, member string, recipe_id string",
    "nodes": "id string, label string, properties_json string",
    "edges": "id string, type string, start_id string, end_id string, properties_json string",
    "evidence": "id string, step_id string, recipe_id string, step_order long, name string, span_start long, span_end long, text string, source_id string, archive string, member string, revision string",
    "associations": "media_id string, recipe_id string, archive string, member string, method string",
}


def small(k: int) -> dict[str, dict[str, dict]]:
    """A graph without faults under the prefix of k: a recipe of two steps, its image, an image of none, a recipe without text."""
    n, text = f"c{k}/", " Cut the leek. \n\nFry it.\n"
    sha = hashlib.sha256(text.encode()).hexdigest()
    at = {"archive": "a", "member": f"{n}r/steps.txt"}
    pic, loose = {"archive": "a", "member": f"{n}r/1.jpg"}, {"archive": "a", "member": f"{n}2.jpg"}
    size = {"size_bytes": 9, "compressed_size_bytes": 8, "crc32": 7}
    node = lambda label, **p: {"label": label, "p": {**SCOPE, **p}}
    edge = lambda kind, start, end: {"type": kind, "start_id": n + start, "end_id": n + end, "p": dict(SCOPE)}
    step = lambda i, words: node("Step", recipe_id=f"{n}r", order=i, text=words, source_id=f"{n}s")
    return {
        "members": {"t": {**at, "kind": "steps", "size": 1, "compressed_size": 1, "crc32": 1}, **{w: {**p, "kind": "image", "size": 9, "compressed_size": 8, "crc32": 7} for w, p in (("p", pic), ("l", loose))}},
        "texts": {"t": {**at, "sha256": sha, "text": text}},
        "recipes": {"r": {"id": f"{n}r", "archive": "a", "folder": f"{n}r", "title": "Leek", "steps_member": at["member"], "n_steps": 2}, "q": {"id": f"{n}q", "archive": "a", "folder": "q", "title": "Q", "steps_member": None, "n_steps": 0}},
        "media": {"p": {**pic, "recipe_id": f"{n}r"}},
        "nodes": {
            "r": node("Recipe", origin_archive="a", recipe_directory=f"{n}r", title="Leek", steps_count=2, text_complete=True),
            "q": node("Recipe", origin_archive="a", recipe_directory="q", title="Q", steps_count=0, text_complete=False),
            "s": node("Source", **at, sha256=sha, source_type=artifacts.TEXT_SOURCE),
            "1": step(1, "Cut the leek."),
            "2": step(2, "Fry it."),
            "ps": node("Source", **pic, source_type="image"),
            "p": node("Image", **pic, source_id=f"{n}ps", **size),
            "ls": node("Source", **loose, source_type="image"),
            "l": node("Image", **loose, source_id=f"{n}ls", **size),
        },
        "edges": {"1": edge("HAS_STEP", "r", "1"), "2": edge("HAS_STEP", "r", "2"), "p": edge("HAS_IMAGE", "r", "p"), "ps": edge("HAS_SOURCE", "p", "ps"), "ls": edge("HAS_SOURCE", "l", "ls")},
        "evidence": {"e": {"step_id": f"{n}1", "recipe_id": f"{n}r", "step_order": 1, "name": "leek", "span_start": 8, "span_end": 12, "text": "Cut the leek.", "source_id": f"{n}s", **at, "revision": "v1"}},
        "associations": {"p": {"media_id": f"{n}p", "recipe_id": f"{n}r", **pic, "method": artifacts.SAME_FOLDER}, "l": {"media_id": f"{n}l", "recipe_id": None, **loose, "method": artifacts.UNMATCHED}},
    }


def put(table, row, **values):
    def fault(g):
        target = g[table][row]
        for name, value in values.items():
            if name in target or table not in ("nodes", "edges"):
                target[name] = value
            else:
                target["p"][name] = value

    return fault


def drop(table, row):
    return lambda g: g[table].pop(row)


def twice(table, row):
    def fault(g):
        g[table]["again"] = {**copy.deepcopy(g[table][row]), "__key": row}

    return fault


FAULTS = [
    (lambda g: None, ""),
    (twice("nodes", "2"), "node_repeated"),
    (put("nodes", "2", split="train"), "node_scope"),
    (put("nodes", "q", dataset_revision=None), "node_scope"),
    (put("nodes", "q", origin_archive="b"), "node_archive recipe_changed"),
    (put("nodes", "2", order="2"), "step_order line_missing line_covered"),
    (put("nodes", "2", order=1.5), "step_order line_missing line_covered"),
    (put("nodes", "2", source_id="none"), "step_source step_recipe_source line_missing line_covered"),
    (put("nodes", "2", recipe_id="none"), "step_recipe_source edge_step_recipe"),
    (put("nodes", "2", text="Fry it"), "line_changed"),
    (put("nodes", "2", text=None), "line_changed"),
    (put("nodes", "2", order=1), "line_changed line_covered line_covered"),
    (drop("nodes", "2"), "line_covered edge_end edge_step_recipe"),
    (drop("nodes", "q"), "recipe_dropped recipe_changed recipe_incomplete_lost"),
    (put("nodes", "q", text_complete=True), "recipe_incomplete_lost"),
    (put("nodes", "r", title="Leeks"), "recipe_changed"),
    (twice("recipes", "q"), "recipe_repeated"),
    (twice("edges", "2"), "edge_repeated"),
    (put("edges", "2", split="train"), "edge_scope"),
    (put("edges", "2", start_id=None), "edge_end edge_step_recipe"),
    (put("edges", "2", end_id="none"), "edge_end edge_step_recipe"),
    (put("evidence", "e", step_id="none"), "evidence_step"),
    (put("evidence", "e", span_end=14), "evidence_span evidence_name"),
    (put("evidence", "e", span_start=None), "evidence_span evidence_name"),
    (put("evidence", "e", span_start=12), "evidence_span evidence_name"),
    (put("evidence", "e", name="Leek"), "evidence_name"),
    (put("evidence", "e", text="Cut."), "evidence_text"),
    (put("evidence", "e", source_id="none"), "evidence_source"),
    (put("evidence", "e", member="none"), "evidence_origin"),
    (put("evidence", "e", revision="v2"), "evidence_origin evidence_scope"),
    (put("evidence", "e", archive="b"), "evidence_origin evidence_scope"),
    (put("evidence", "e", step_order=2), "evidence_recipe"),
    (put("texts", "t", sha256="0"), "text_hash source_hash"),
    (twice("texts", "t"), "text_repeated line_covered line_covered"),
    (drop("texts", "t"), "source_text line_missing line_missing"),
    (twice("members", "t"), "member_repeated"),
    (drop("members", "t"), "source_member"),
    (put("nodes", "s", sha256=None), "source_hash"),
    (put("nodes", "s", source_type="image"), "text_covered"),
    (put("nodes", "p", crc32=None), "media_member"),
    (put("nodes", "p", size_bytes=10), "media_member"),
    (put("members", "p", kind="video"), "media_member"),
    (drop("nodes", "l"), "media_covered orphan_dropped association_media edge_end"),
    (drop("edges", "ps"), "media_link"),
    (drop("edges", "ls"), "media_link orphan_link"),
    (put("edges", "p", type="HAS_VIDEO"), "association_link"),
    (drop("edges", "p"), "association_link"),
    (put("associations", "p", archive="b"), "association_origin association_folder"),
    (put("associations", "p", recipe_id="none"), "association_recipe association_link"),
    (put("nodes", "r", recipe_directory="none"), "recipe_changed association_folder"),
    (put("associations", "l", method=None), "association_reason"),
    (put("associations", "p", recipe_id=None, method=artifacts.UNMATCHED), "association_known association_linked"),
    (put("nodes", "l", source_id="none"), "media_source media_link orphan_link"),
    (put("edges", "p", end_id=None), "edge_end association_link"),
]


def tables(spark, graphs):
    rows = {t: [] for t in COLUMNS}
    for k, g in enumerate(graphs):
        for t, held in g.items():
            for key, r in held.items():
                r = dict(r)
                key = r.pop("__key", key)
                if t in ("nodes", "edges"):
                    r["properties_json"] = json.dumps(r.pop("p"))
                if t in ("nodes", "edges", "evidence"):
                    r["id"] = f"c{k}/{key}"
                rows[t].append(r)
    made = {t: spark.createDataFrame([tuple(r[c.split()[0]] for c in COLUMNS[t].split(", ")) for r in rows[t]], COLUMNS[t]) for t in COLUMNS}
    first = ("members", "texts", "recipes", "media")
    return artifacts.Originals(*[made[t] for t in first]), artifacts.Graph(*[made[t] for t in COLUMNS if t not in first])


def test_each_fault_is_found_alone(spark):
    graphs = []
    for k, (fault, _) in enumerate(FAULTS):
        graphs.append(small(k))
        fault(graphs[-1])
    found = {k: [] for k in range(len(FAULTS))}
    for r in artifacts.audited(*tables(spark, graphs), "v1", ["a"]).collect():
        found[int(re.search(r"c(\d+)/", r.id)[1])].append(r.rule)
    wanted = {k: sorted(rules.split()) for k, (_, rules) in enumerate(FAULTS)}
    assert {k: sorted(v) for k, v in found.items()} == wanted
    never = set(artifacts.RULES) - {r for rules in wanted.values() for r in rules}
    assert never == {"node_id", "association_archive", "member_archive", "text_archive"}  # the next test breaks these


def test_nulls_other_archives_and_empty_tables(spark):
    graph = small(0)
    graph["nodes"]["2"]["p"] = None  # JSON's null is no object
    originals, made = tables(spark, [graph])
    counts = {r.rule: r.n_broken for r in artifacts.report(artifacts.audited(originals, made, "v1", ["b"])).collect()}
    assert set(counts) == set(artifacts.RULES)
    assert (counts["member_archive"], counts["text_archive"], counts["association_archive"], counts["node_archive"]) == (3, 1, 2, 7)
    assert counts["step_order"] == 1 and counts["node_scope"] == 1
    null = spark.createDataFrame([(None, None, None)], COLUMNS["nodes"]).withColumn("n", artifacts.F.lit(1))
    rules = artifacts.audited(originals, artifacts.Graph(made.nodes.withColumn("n", artifacts.F.lit(0)).unionByName(null), made.edges, made.evidence, made.associations), "v1", ["a"]).where("id IS NULL").collect()
    assert {r.rule for r in rules} == {"node_id", "node_scope"}
    none = [spark.createDataFrame([], s) for s in COLUMNS.values()]
    assert artifacts.audited(artifacts.Originals(*none[:4]), artifacts.Graph(*none[4:]), "v1", []).count() == 0
