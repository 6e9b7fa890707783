"""A bundle's violations: made once for all rules, whatever goes out whole and whatever is dealt."""

import pytest

from graphloom.operators import bundles
from graphloom.plans.catalogue import QUERIES


@pytest.mark.parametrize("few", [0, 100])
def test_violations_by_hand(spark, few, monkeypatch):
    monkeypatch.setattr(bundles, "FEW", few, raising=False)
    frame = spark.createDataFrame
    nodes = frame([("u", "Video", "u", True), ("v", "Video", "v", True), ("f", "Frame", "u", False), ("f", "Frame", "u", False), ("g", "Frame", "u", False), ("h", "Frame", "v", False), ("old", "Frame", "u", False), (None, "Frame", "u", False), ("odd", "Film", "u", False)], "id string, label string, owner string, reference boolean")
    links = [("1", "u", "f", "HAS_FRAME", "u"), ("1", "u", "g", "HAS_FRAME", "u"), (None, "f", "g", "BEFORE", "u"), ("2", "g", "f", "BEFORE", "u"), ("3", "g", "h", "BEFORE", "u"), ("4", "u", "lost", "HAS_FRAME", "u"), ("5", "f", "f", "BEFORE", "u"), ("6", "f", "u", "HAS_FRAME", "u"), ("7", "f", "g", "LIKES", "u"), ("8", "u", "old", "HAS_FRAME", "u")]
    relationships = frame(links, "id string, start_id string, end_id string, type string, owner string")
    base = frame([("u", "Video"), ("v", "Image"), ("old", "Frame")], "id string, label string")
    times = frame([("f", 1), ("g", 2), ("h", 3)], "id string, at int")
    got = {tuple(r) for r in bundles.bundle_violations(nodes, relationships, base, {"Frame"}, {"Video"}, {"HAS_FRAME": ({"Video"}, {"Frame"}), "BEFORE": ({"Frame"}, {"Frame"})}, times).collect()}
    assert got == {("f", "repeated_node"), (None, "repeated_node"), ("1", "repeated_relationship"), (None, "repeated_relationship"), ("odd", "label"), ("v", "unknown_reference"), ("old", "existing_id"), ("2", "order"), ("3", "owner"), ("4", "dangling"), ("5", "self_loop"), ("5", "order"), ("6", "endpoint_label"), ("7", "type"), (None, "unattached"), ("odd", "unattached")}


def test_bundle_is_dealt_few_times(spark, shuffled, folder):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with larger tables
    try:
        dealt = shuffled(lambda: QUERIES["q_bundle_violations"](spark, "/root/testdata/sf0.01").write.parquet(f"{folder}/out"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert dealt < 1300 * events
