"""Progress of a run whose items are orders: line items as media, a report spoilt in known places, and a graph of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import progress
from .registry import query, table


def told(spark, d):
    """(expected, items, held): remainders of the order's key say what was told wrongly."""
    k = F.col("k")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count_if(F.col("l_returnflag") != "R").alias("images"), F.count_if(F.col("l_returnflag") == "R").alias("videos"), F.collect_set(F.col("l_partkey").cast("string")).alias("media_ids"))
    zero, none = F.lit(0).cast("long"), F.array().cast("array<string>")
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("k")).join(lines, "k", "left").select("k", F.coalesce("images", zero).alias("images"), F.coalesce("videos", zero).alias("videos"), F.coalesce("media_ids", none).alias("media_ids"))
    run, n = F.concat(F.lit("run"), k), F.col("images") + F.col("videos") * 2
    ids = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda x: F.concat(run, F.lit("/"), x))).otherwise(none)
    right = rows.select("k", run.alias("run_id"), "images", "videos", (F.col("videos") * 2).alias("clips"), (F.col("videos") * 3).alias("frames"), n.alias("observations"), zero.alias("aligned"), (n + 1).alias("nodes"), n.alias("edges"), ids.alias("observation_ids"), "media_ids")
    status = F.when(k % 5 == 0, "failed").when(k % 7 == 0, "processing").otherwise("verified")
    spoilt = {
        "images": F.when(k % 11 == 0, F.col("images") + 1).otherwise(F.col("images")),
        "aligned": F.when(k % 13 == 0, F.col("observations") + 1).otherwise(F.col("aligned")),
        "frames": F.when(k % 17 == 0, None).otherwise(F.col("frames")),
        "run_id": F.when(k % 19 == 0, "run").otherwise(F.col("run_id")),
        "nodes": F.when(k % 23 == 0, F.col("nodes") + 1).otherwise(F.col("nodes")),
    }
    items = right.where("k % 29 <> 0").withColumn("status", status).withColumns(spoilt).withColumn("item", k)
    expected = rows.where("k % 31 <> 0").withColumnRenamed("k", "item")
    media = F.when(k % 37 == 0, F.array(F.lit("none"))).otherwise(F.col("media_ids"))
    held = right.where(status.eqNullSafe("verified") & (k % 29 != 0) & (k % 19 != 0) | (k % 41 == 0)).withColumn("media_ids", media)
    return expected, items, held


_STATES = """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'failed' WHEN o_orderkey % 7 = 0 THEN 'processing' ELSE 'verified' END AS status FROM orders),
l AS (SELECT l_orderkey AS k, count_if(l_returnflag <> 'R') AS images, count_if(l_returnflag = 'R') AS videos FROM lineitem GROUP BY 1),
shared AS (SELECT count(*) AS n FROM o WHERE status = 'verified' AND k % 19 = 0),
r AS (SELECT k, status, k % 31 <> 0 AS wanted, coalesce(images, 0) AS images, coalesce(videos, 0) AS videos, CASE WHEN k % 31 <> 0 AND status = 'verified' THEN list_filter([
CASE WHEN k % 17 = 0 THEN 'counts' END, CASE WHEN k % 11 = 0 THEN 'media' END, CASE WHEN k % 11 = 0 THEN 'observations' END, CASE WHEN k % 13 = 0 THEN 'aligned' END, CASE WHEN k % 17 = 0 THEN 'windows' END,
CASE WHEN k % 19 = 0 AND shared.n <> 1 THEN 'run' END, CASE WHEN k % 13 = 0 OR k % 17 = 0 OR k % 19 = 0 OR k % 23 = 0 THEN 'graph' END, CASE WHEN k % 19 = 0 OR k % 37 = 0 THEN 'graph_media' END], lambda x: x IS NOT NULL) ELSE [] END AS reasons FROM o LEFT JOIN l USING (k), shared),
s AS (SELECT k::VARCHAR AS item, CASE WHEN NOT wanted THEN 'unexpected' WHEN status = 'verified' THEN CASE WHEN len(reasons) = 0 THEN 'verified' ELSE 'inconsistent' END WHEN status = 'failed' THEN 'failed' ELSE 'pending' END AS state, reasons, images, videos FROM r WHERE wanted OR status IS NOT NULL
UNION ALL SELECT 'run:run' || k, 'unexpected', [], 0, 0 FROM o WHERE k % 41 = 0 AND (status IS NULL OR status <> 'verified' OR k % 19 = 0)) """


@query(_STATES + "SELECT item, state, array_to_string(reasons, ',') AS reasons FROM s")
def q_item_states(spark, d):
    return progress.item_states(*told(spark, d)).select("item", "state", F.array_join("reasons", ",").alias("reasons"))


@query(_STATES + """, t AS (SELECT count_if(state = 'verified') AS verified, count_if(state = 'inconsistent') AS inconsistent, count_if(state = 'failed') AS failed, count_if(state = 'pending') AS pending, count_if(state = 'unexpected') AS unexpected, coalesce(sum(CASE WHEN state = 'verified' THEN images END), 0) AS images, coalesce(sum(CASE WHEN state = 'verified' THEN videos END), 0) AS videos FROM s),
f AS (SELECT unnest([{'name': 'expected', 'found': verified + inconsistent + failed + pending}, {'name': 'verified', 'found': verified}, {'name': 'inconsistent', 'found': inconsistent}, {'name': 'failed', 'found': failed}, {'name': 'pending', 'found': pending}, {'name': 'unexpected', 'found': unexpected}, {'name': 'images', 'found': images}, {'name': 'videos', 'found': videos}, {'name': 'complete', 'found': (inconsistent + failed + pending + unexpected = 0)::BIGINT}], recursive := true) FROM t),
c AS (SELECT 'expected' AS name, count_if(o_orderkey % 31 <> 0) AS claimed FROM orders UNION ALL SELECT 'complete', 1)
SELECT name, claimed::BIGINT AS claimed, found::BIGINT AS found, claimed IS NOT DISTINCT FROM found AS agrees FROM f LEFT JOIN c USING (name)""")
def q_scope_progress(spark, d):
    """A run's totals: one that is right, one that claims to be complete and is not, and what it does not claim."""
    expected, items, held = told(spark, d)
    claimed = expected.agg(F.count("*").alias("n")).select(F.explode(F.array(F.struct(F.lit("expected").alias("name"), "n"), F.struct(F.lit("complete").alias("name"), F.lit(1).cast("long").alias("n")))).alias("x")).select("x.*")
    return progress.scope_progress(progress.item_states(expected, items, held), expected, claimed)
