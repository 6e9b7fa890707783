"""Evidence rules over VARIANT paths: types are told apart, nothing is taken for something else."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom.operators.embedded import Json, evidence_violations

SCOPE = {"build_id": "b", "split": "test", "dataset_revision": "r"}


def test_paths_and_types(spark):
    texts = ['{"a": 1, "b": null, "c": "x", "d": true, "e": [1, 2.5], "f": {"g": 1e400}, "h": "1", "i": " "}', "[1]", "1", "null", "{broken", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("v", F.try_parse_json("t"))
    v = Json(F.col("v"))
    row = df.select("i", v.is_object().alias("o"), v.number("$.a").alias("a"), v.number("$.d").alias("d"), v.number("$.h").alias("h"), v.is_null("$.b").alias("b"), v.is_null("$.z").alias("z"), v.text("$.a").alias("ta"), v.text("$.c").alias("c"), v.filled("$.i").alias("i_"), v.vector("$.e", 2).alias("e"), v.vector("$.a", 1).alias("va")).orderBy("i").collect()
    assert tuple(row[0])[1:] == (True, 1.0, None, None, True, False, None, "x", False, True, False)
    assert [r.o for r in row] == [True] + [False] * 6


@pytest.mark.parametrize("change, reasons", [
    ({}, []),
    ({"confidence": 0.5}, ["confidence"]),
    ({"confidence": ...}, ["confidence"]),
    ({"verified": True}, ["verified"]),
    ({"verified": "false"}, ["verified"]),
    ({"verified": 0}, ["verified"]),
    ({"similarity_score": True}, ["similarity"]),
    ({"similarity_score": -1}, []),
    ({"embedding": [0, 0, 0]}, ["embedding"]),
    ({"embedding": [1, 2]}, ["embedding"]),
    ({"embedding": [1, True, 0]}, ["embedding"]),
    ({"embedding": [1, "2", 0]}, ["embedding"]),
    ({"raw_json": "[]"}, ["raw_output"]),
    ({"raw_json": {}}, ["raw_output"]),
    ({"source_media_id": "nowhere"}, ["evidence_binding", "medium", "source"]),
    ({"build_id": "other"}, ["scope"]),
    ({"evidence_json": ...}, ["evidence"]),
    ({"evidence": {"split": "train"}}, ["evidence_scope"]),
    ({"evidence": {"url": "u"}}, ["evidence_url"]),
    ({"evidence": {"member": "m"}}, []),
    ({"model": " "}, ["model"]),
])
def test_observation_rules(spark, change, reasons):
    base = {"source_media_id": "v1", "source_id": "s1", "verified": False, "confidence": None, "semantics": "model_candidate", "model": "m", "embedding": [0, 0.5, 2], "embedding_model": "e", "raw_json": "{}"}
    evidence = {"source_media_id": "v1", "source_id": "s1"} | change.get("evidence", {})
    made = {k: v for k, v in (base | {"evidence_json": json.dumps(evidence)} | {k: v for k, v in change.items() if k != "evidence"}).items() if v is not ...}
    nodes = spark.createDataFrame([("n", "VisualObservation", json.dumps(made)), ("r", "SemanticRun", "{}"), ("q", "SemanticRun", '{"source_id": "s1"}'), ("x", None, None)], "id string, label string, properties_json string")
    media = spark.createDataFrame([("v1", "Video", "s1")], "id string, label string, source_id string")
    sources = spark.createDataFrame([("s1", "a.zip", "m", None, None, "b", "test", "r")], "id string, archive string, member string, artifact_path string, url string, build_id string, split string, dataset_revision string")
    found = sorted((r.id, r.reason) for r in evidence_violations(nodes, media, sources, SCOPE, dimensions=3).collect())
    assert found == sorted([("n", x) for x in reasons] + [("q", "run_source"), ("x", "properties")])
