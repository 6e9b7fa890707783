"""Every query with SQL against DuckDB on the smallest tables."""

import pytest

import __spark_entry__ as entry_module
from graphloom.plans.catalogue import ORACLES, QUERIES

from .oracle import differences, n_rows

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    assert differences(QUERIES[name](spark, SMALL), ORACLES[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert sorted(r.position for r in rows) == list(range(1, 11))


def test_registry():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_mentions_and_alignment_take_all_rows(spark):
    read = lambda name: spark.read.parquet(f"{SMALL}/{name}.parquet")
    other = {r.doc_id for r in read("documents").where("lang <> 'en' AND regexp_like(text, '(?i)\\\\b(the|that|with|from)\\\\b')").collect()}
    assert other and other <= {r.doc_id for r in QUERIES["q_mentions"](spark, SMALL).collect()}
    assert other <= {r.doc_id for r in QUERIES["q_mention_rollup"](spark, SMALL).collect()}
    rows = QUERIES["q_align_dp"](spark, SMALL).collect()
    assert {int(r.media) % 5 for r in rows} == set(range(5))
    # one event of a day alone takes a step wherever one of its scores is above the threshold
    days = read("events").selectExpr("event_id", "value", "concat_ws(':', user_id, floor(unix_micros(cast(ts AS timestamp)) / 86400000000)) AS day").collect()
    size = {}
    for r in days:
        size[r.day] = size.get(r.day, 0) + 1
    alone = {str(r.event_id) for r in days if size[r.day] == 1 and any(int(r.value // 1) * (k + 3) % 100 > 50 for k in range(3))}
    assert alone and alone <= {r.media for r in rows}


def test_queries_away_from_the_repository(folder):
    """Python workers find the package wherever the driver's working folder is."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__
for name in ("q_mentions", "q_mention_rollup", "q_span_check", "q_chunk_pack", "q_chunk_coverage", "q_align_dp", "q_tf_df", "q_normalized_span", "q_json_faults", "q_repaired_names"):
    assert __spark_entry__.queries()[name](spark, {SMALL!r}).count() > 0, name
print("all ran")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=folder, env=env, capture_output=True, text=True, timeout=400)
    assert "all ran" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("name", sorted(set(ORACLES) & {"q_subgraph", "q_span_check", "q_chunk_coverage", "q_bundle_violations", "q_ranking_audit", "q_metric_audit", "q_answer_violations", "q_selection_violations", "q_detail_contract", "q_gold_pairs", "q_gold_exclusions", "q_normalized_span", "q_vector_audit", "q_verified_corpus"}))
def test_audits_are_not_vacuous(name):
    assert n_rows(ORACLES[name], SMALL) > 0  # and the query's rows are these
