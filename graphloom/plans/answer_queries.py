"""Answers, recommendations and evaluated cases that are spoilt in known places, with what their checks must say."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guided, metrics
from ..operators.constraints import Constraints
from ..operators.scans import Ranges, plain
from .registry import query, table


@query("""WITH e AS (SELECT user_id AS u, event_id AS n, (props->>'k')::BIGINT AS k, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
p AS (SELECT u, n, k, i, 1 AS place FROM e UNION ALL SELECT u, n, k, i, 2 FROM e WHERE u % 5 = 0), next AS (SELECT n - 1 AS n, true AS follows FROM e), users AS (SELECT DISTINCT u FROM e),
f AS (SELECT u AS answer_id, place, i AS position, unnest(list_filter([CASE WHEN n % 19 = 0 THEN 'reordered_step' END, CASE WHEN n % 13 = 0 THEN 'text' END, CASE WHEN n % 17 = 0 THEN 'citations' END, CASE WHEN n % 17 <> 0 AND n % 11 = 0 AND follows IS NULL THEN 'unknown_citation' END, CASE WHEN n % 17 <> 0 AND n % 11 = 0 AND follows THEN 'citation_source' END, CASE WHEN n % 7 = 0 THEN 'unsupported_number' END], lambda x: x IS NOT NULL)) AS reason FROM p LEFT JOIN next USING (n) WHERE n % 97 <> 0)
SELECT * FROM f UNION ALL SELECT u, place, NULL, 'incomplete_steps' FROM p WHERE n % 97 = 0 GROUP BY 1, 2 UNION ALL SELECT u, place, NULL, 'repeated_recipe' FROM p WHERE u % 5 = 0 GROUP BY 1, 2
UNION ALL SELECT u, 3, NULL, 'unknown_recipe' FROM users WHERE u % 7 = 0 UNION ALL SELECT u, 3, 1, 'reordered_step' FROM users WHERE u % 7 = 0
UNION ALL SELECT u, NULL, NULL, 'recipe_count' FROM users WHERE u % 35 = 0""")
def q_walk_violations(spark, d):
    """A user's events as a recipe, retold: other steps, texts, numbers and citations, a step left out, a recipe twice, one of none."""
    n = F.col("event_id")
    rows = table(spark, d, "events").select(F.col("user_id").cast("string").alias("recipe_id"), "user_id", n, F.from_json("props", "k long").getField("k").alias("k"))
    steps = rows.select("recipe_id", n.alias("order"), n.cast("string").alias("step_id"), F.concat(F.lit("k is "), "k").alias("text"), F.lit("s").alias("source_id"))
    evidence = steps.select(F.concat(F.lit("E"), "step_id").alias("evidence_id"), F.lit("step").alias("kind"), "recipe_id", "step_id", "source_id")
    placed = plain(Ranges(rows, ["user_id"], "event_id").numbered("position"))
    said = F.concat(F.when(n % 13 == 0, "take ").otherwise("取 "), F.col("k") + F.when(n % 7 == 0, 1000).otherwise(0))
    cites = F.when(n % 17 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("E"), n + F.when(n % 11 == 0, 1).otherwise(0))))
    told = placed.where("event_id % 97 <> 0").select(F.col("user_id").alias("answer_id"), F.explode(F.when(F.col("user_id") % 5 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("place"), "recipe_id", "position", F.when(n % 19 == 0, "0?").otherwise(n.cast("string")).alias("step_id"), said.alias("text"), cites.alias("citations"))
    any_ = rows.where("event_id % 97 <> 0").groupBy("user_id").agg(F.min("event_id").alias("n")).where("user_id % 7 = 0")
    other = any_.select("user_id", F.lit(3), F.lit("none"), F.lit(1), F.lit("0"), F.lit("取"), F.array(F.concat(F.lit("E"), "n")))
    return guided.walk_violations(told.union(other), steps, evidence, 2)


@query("""WITH r AS (SELECT o_orderkey AS question, o_orderkey AS k, o_totalprice AS m, o_orderpriority AS t FROM orders)
SELECT question, k AS recipe_id, unnest(list_filter([CASE WHEN k % 23 = 0 OR m > 200000 OR t = '5-LOW' THEN 'demands' END, CASE WHEN k % 11 = 0 THEN 'candidate' END, CASE WHEN k % 7 = 0 THEN 'evidence' END, CASE WHEN k % 23 = 0 OR k % 13 = 0 THEN 'details' END], lambda x: x IS NOT NULL)) AS reason FROM r""")
def q_output_violations(spark, d):
    """Every order recommended; some are too dear, were no candidate, cite what was not handed out or say other minutes."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("question"), k.alias("recipe_id"), F.array("o_orderstatus").alias("steps"), F.array(F.lit("x")).alias("members"), F.col("o_totalprice").alias("minutes"), "o_orderpriority")
    none = F.array().cast("array<string>")
    r = F.col("recipe_id")
    recommended = rows.select("question", "recipe_id", "steps", "members", F.when(r % 13 == 0, F.col("minutes") + 1).otherwise(F.col("minutes")).alias("minutes"), F.array(F.lit("E1"), F.when(r % 7 == 0, "E9").otherwise("E2")).alias("evidence_ids"))
    facts = rows.where("recipe_id % 23 <> 0").select("recipe_id", "steps", "members", none.alias("extras"), "minutes", F.array(F.when(F.col("o_orderpriority") == "5-LOW", "low").otherwise("fine")).alias("tags"), F.lit("n").alias("name"))
    evidence = rows.select("question", F.explode(F.array(F.lit("E1"), F.lit("E2"))).alias("evidence_id"))
    return guided.output_violations(recommended, rows.where("recipe_id % 11 <> 0").select("question", "recipe_id"), facts, evidence, Constraints(at_most=200000.0, required_tags=("fine",), allow_missing=True))


@query("""WITH r AS (SELECT o_orderkey AS k, o_orderpriority AS kind, o_totalprice AS ms, k % 3 <> 0 AND k % 17 <> 0 AS same, k % 3 <> 0 AND k % 17 <> 0 AND k % 5 <> 0 AND k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0 AS ok FROM orders), b AS (SELECT kind, ms, same, ok, k FROM r UNION ALL SELECT 'all', ms, same, ok, k FROM r)
SELECT kind, count(*) AS total, sum(ok::INT)::BIGINT AS passed, round(avg(ok::INT), 4) AS pass_rate, round(avg(same::INT), 4) AS candidate_set_accuracy, median(CASE WHEN k % 17 <> 0 THEN ms END) AS median_ms FROM b GROUP BY 1""")
def q_functional_cases(spark, d):
    """Cases with another status, other candidates, a recommendation from elsewhere or too many, a failed validation, or no result."""
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(k.alias("case_id"), F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("ms"))
    c = F.col("case_id")
    ids = lambda *names: F.array(*[F.lit(n) for n in names])
    cases = rows.select("case_id", "kind", F.lit("ok").alias("status"), ids("b", "a").alias("ids"))
    results = rows.where("case_id % 17 <> 0").select("case_id", F.when(c % 5 == 0, "no_results").otherwise("ok").alias("status"), F.when(c % 3 == 0, ids("a")).otherwise(ids("a", "b")).alias("candidate_ids"), F.when(c % 7 == 0, ids("c")).otherwise(ids("a", "b")).alias("recommended_ids"), F.when(c % 11 == 0, 1).otherwise(3).alias("top_k"), (c % 13 != 0).alias("valid"), "ms")
    return metrics.functional(cases, results)
