import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from graphloom.sources import builds, readers
from graphloom.streaming import queue, windows


def write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


def test_document(spark, folder):
    recipe = {"id": "r", "name": "n", "ingredients": ["egg", "tofu", "egg"], "seasonings": [], "minutes": None, "tags": [], "steps": ["stir", "stir"], "source": {"id": "s", "title": "t", "url": "u"}, "images": [], "videos": []}
    path = write(f"{folder}/d.json", json.dumps({"schema_version": 1, "dataset": {}, "ingredient_aliases": {"tofu": "bean curd"}, "recipes": [recipe]}, indent=1))
    docs = readers.document(spark, path)
    row = readers.canonical_recipes(docs).first()
    assert row.ingredients == ["egg", "bean curd"] and row.steps == ["stir", "stir"] and row.minutes is None


def test_lines_and_checkpoints(spark, folder):
    write(f"{folder}/a.jsonl", '{"k": "x", "v": 1}\n\n{"k": "y", "v": 2}\n{"k": "x", "v": 3}\n{"k": "z", "v"')
    got = {r.k: r.v for r in readers.checkpoint_lines(spark, f"{folder}/a.jsonl", "k", "k string, v int").collect()}
    assert got == {"x": 3, "y": 2}
    write(f"{folder}/b.jsonl", '{"k": "x"\n{"k": "y", "v": 2}\n')
    with pytest.raises(Exception, match="torn line"):
        readers.checkpoint_lines(spark, f"{folder}/b.jsonl", "k", "k string, v int").collect()
    with gzip.open(f"{folder}/c.json.gz", "wt") as f:
        f.write('{"k": "x", "v": 1}\n')
    assert readers.json_lines(spark, f"{folder}/c.json.gz", "k string, v int").first().v == 1


def test_csv(spark, folder):
    nodes = spark.createDataFrame([("a", "L", 1, 'say "hi",\nyou'), ("b", "L", 2, None)], "id string, label string, n int, t string")
    edges = spark.createDataFrame([("e", "a", "b", "T")], "id string, start_id string, end_id string, type string")
    builds.export_graph(nodes, edges, folder)
    back = readers.strict_csv(spark, f"{folder}/nodes", readers.NODE_CSV)
    assert {r.id: json.loads(r.properties_json) for r in back.collect()} == {"a": {"n": 1, "t": 'say "hi",\nyou'}, "b": {"n": 2}}
    assert {(r.what, r.name) for r in readers.described(back, readers.strict_csv(spark, f"{folder}/relationships", readers.EDGE_CSV)).collect()} == {("label", "L"), ("type", "T"), ("node_property", "n"), ("node_property", "t")}
    with pytest.raises(ValueError):
        readers.strict_csv(spark, f"{folder}/nodes", readers.EDGE_CSV)


def test_json_faults(spark):
    texts = ['{"a": 1}', '{"a": 1, "a": 2}', '{"a": NaN}', "{", "[1]", None]
    got = [r.f for r in spark.createDataFrame([(t,) for t in texts], "t string").select(readers.json_fault("t").alias("f")).collect()]
    assert got == [None, "repeated key", "number NaN", "malformed", "no object", "malformed"]


def test_archives(spark, folder):
    with zipfile.ZipFile(f"{folder}/x.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("r1/goal.txt", "﻿Soup")
        z.writestr("r1/steps.txt", "chop\n\n stir \n")
        z.writestr("r2/steps.txt", "煮".encode("gb18030"))
        z.writestr("r1/a.jpg", b"\xff\xd8")
    members = readers.archive_members(spark, folder)
    assert {r.member: r.kind for r in members.collect()} == {"r1/goal.txt": "goal", "r1/steps.txt": "steps", "r2/steps.txt": "steps", "r1/a.jpg": "image"}
    got = {r.folder: r for r in readers.records(members).collect()}
    assert got["r1"].title == "Soup" and [(s.order, s.text) for s in got["r1"].steps] == [(1, "chop"), (2, "stir")] and got["r1"].media[0].member == "r1/a.jpg"
    assert got["r2"].title is None and got["r2"].steps[0].text == "煮" and got["r2"].quality_flags == ["no_title"]
    plan = readers.read_plan(members).collect()
    assert len(plan) == 1 and plan[0].n_members == 3  # the last member's end is not known


def test_selection_and_mapping(spark):
    df = spark.createDataFrame([(str(i), "" if i % 2 else "t", "u") for i in range(5)], "id string, title string, text string")
    assert [r.id for r in readers.selection(df, "id", 1, 2).collect()] == ["1", "2"] and readers.selection(df, "id").count() == 5
    assert [r.name for r in readers.mapped(df, {"name": ["title", "text"], "other": ["none"]}).collect()] == ["t", "u", "t", "u", "t"]


def test_changed_files(spark, folder):
    import hashlib

    write(f"{folder}/a.txt", "a")
    write(f"{folder}/b.txt", "b")
    manifest = spark.createDataFrame([("a.txt", hashlib.sha256(b"a").hexdigest()), ("b.txt", "0"), ("c.txt", "0")], "name string, sha256 string")
    assert sorted(r.name for r in readers.changed_files(spark, folder, manifest).collect()) == ["b.txt", "c.txt"]


def test_builds(spark, folder):
    store = builds.Builds(spark, folder)
    with pytest.raises(builds.BuildError):
        store.active()
    df = spark.createDataFrame([(1, "a"), (2, None)], "i long, s string")
    store.publish("one", df)
    store.publish("two", df.limit(1))
    assert store.active() == "two" and store.read().count() == 1 and store.read("one").count() == 2
    with pytest.raises(builds.BuildError):
        store.publish("one", df)


def test_upserts(spark):
    old, new = (spark.createDataFrame(rows, "k string, v string") for rows in ([("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")]))
    assert sorted(tuple(r) for r in builds.upserted(old, new, "k").collect()) == [("a", "1"), ("b", "3"), ("c", "4")]
    with pytest.raises(builds.BuildError):
        builds.append_only(old, new, "k", "v")
    assert [r.k for r in builds.append_only(old, new.where("k <> 'b'").union(old.limit(1)), "k", "v").collect()] == ["c"]
    assert [r.k for r in builds.todo(new, old, "k").collect()] == ["c"]


def test_queue(spark, folder):
    src = f"{folder}/in"
    events = spark.createDataFrame([(1, 10), (2, 20), (2, 20)], "id long, at long").withColumn("ts", F.timestamp_seconds("at"))
    events.write.parquet(src)
    stream = lambda: spark.readStream.schema(events.schema).parquet(src)
    tries = []

    def work(batch):
        tries.append(1)
        if len(tries) == 1:
            raise RuntimeError("once")
        return batch.groupBy("id").count()

    for _ in range(2):  # a second run finds nothing new
        queue.process_stream(stream(), work, f"{folder}/out", f"{folder}/check").awaitTermination()
    assert sorted((r.id, r["count"]) for r in spark.read.parquet(f"{folder}/out").collect()) == [(1, 1), (2, 2)]
    once = windows.late_tolerant(stream(), "ts", "1 minute", "id").writeStream.format("memory").queryName("once").outputMode("append").trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == 2
    queue.guarded(spark, folder, "run", "s1")
    queue.guarded(spark, folder, "run", "s1")
    with pytest.raises(queue.SignatureError):
        queue.guarded(spark, folder, "run", "s2")
