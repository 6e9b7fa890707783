"""Recipe detail over orders: lines as steps, customers as sources, parts as ingredients, suppliers as media, events as observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detail
from .registry import query, table


@query("""WITH l AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem), st AS (SELECT *, o || '-' || n || '-' || p || '-' || s AS id FROM l),
steps AS (SELECT o, string_agg(id, ',' ORDER BY n, id) AS steps FROM st GROUP BY 1), ing AS (SELECT o, string_agg(name, ',' ORDER BY name) AS ingredients FROM (SELECT DISTINCT o, p_name AS name FROM l JOIN part ON p_partkey = p) GROUP BY 1),
md AS (SELECT DISTINCT o, s FROM l JOIN supplier ON s_suppkey = s), media AS (SELECT o, count_if(s % 2 = 0) AS images, count_if(s % 2 = 1) AS videos, count_if(s % 6 = 0) AS downloaded_images, count_if(s % 3 = 0 AND s % 2 = 1) AS downloaded_videos, string_agg('s' || s, ',' ORDER BY 's' || s) AS inventory FROM md GROUP BY 1),
runs AS (SELECT event_type AS run, max(epoch_us(ts)) AS ended FROM events WHERE event_type <> 'error' GROUP BY 1),
seen AS (SELECT user_id AS s, event_id, event_type AS run FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ended DESC NULLS LAST, 'e' || event_id DESC) AS n FROM events LEFT JOIN runs ON run = event_type WHERE event_id % 3 <> 0) WHERE n = 1),
vis AS (SELECT md.o, string_agg('s' || md.s || ':e' || event_id || ':' || coalesce(st.n::VARCHAR, ''), ',' ORDER BY 's' || md.s, st.n, st.id) AS visual FROM md JOIN seen ON seen.s = md.s LEFT JOIN st ON st.o = md.o AND st.s = md.s AND st.n % 2 = 0 AND seen.run <> 'error' WHERE md.s % 2 = 0 GROUP BY 1)
SELECT o_orderkey AS id, o_orderstatus AS status, coalesce(steps, '') AS steps, CASE WHEN c_custkey IS NULL THEN '' ELSE 'goal:c' || c_custkey END AS sources, coalesce(ingredients, '') AS ingredients, coalesce(images, 0) AS images, coalesce(videos, 0) AS videos, coalesce(downloaded_images, 0) AS downloaded_images, coalesce(downloaded_videos, 0) AS downloaded_videos, coalesce(inventory, '') AS inventory, coalesce(visual, '') AS visual
FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN steps ON steps.o = o_orderkey LEFT JOIN ing ON ing.o = o_orderkey LEFT JOIN media ON media.o = o_orderkey LEFT JOIN vis ON vis.o = o_orderkey""")
def q_recipe_detail(spark, d):
    c, lit, of = F.col, F.lit, lambda prefix, column: F.concat(lit(prefix), column)
    lines = table(spark, d, "lineitem").select(c("l_orderkey").cast("string").alias("o"), "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("step"), "l_partkey", of("s", c("l_suppkey")).alias("s"))
    orders = table(spark, d, "orders").select(c("o_orderkey").cast("string").alias("id"), c("o_orderstatus").alias("status"), of("c", c("o_custkey")).alias("c"))
    link = lambda df, kind, start, end, role=lit(None), run=lit(None): df.select(start.alias("start_id"), end.alias("end_id"), kind.alias("type"), role.cast("string").alias("role"), lit(None).cast("string").alias("method"), run.cast("string").alias("run_id"), lit(None).cast("double").alias("score"))
    media_kind = F.when(c("n") % 2 == 0, "image").otherwise("video")
    supplier = table(spark, d, "supplier").select(of("s", c("s_suppkey")).alias("id"), c("s_suppkey").alias("n"))
    media = supplier.select("id", media_kind.alias("kind"), c("id").alias("source_id"), (c("n") % 3 == 0).alias("downloaded"), lit("remote").alias("storage"), lit("not_run").alias("recognition"))
    number = F.substring("s", 2, 20).cast("long")
    links = link(lines, lit("HAS_STEP"), c("o"), c("step")).union(link(orders, lit("HAS_SOURCE"), c("id"), c("c"), lit("goal"))).union(link(lines, lit("HAS_INGREDIENT"), c("o"), of("p", c("l_partkey"))))
    runs_ = F.array(*[lit(x) for x in ("signup", "click", "view", "purchase")])  # every kind of event but errors
    aligned = lines.where("l_linenumber % 2 = 0").select("s", "step", F.explode(runs_).alias("run"))
    links = links.union(link(lines, F.when(number % 2 == 0, "HAS_IMAGE").otherwise("HAS_VIDEO"), c("o"), c("s"))).union(link(aligned, lit("ALIGNED_WITH"), c("s"), c("step"), run=c("run")))
    parts = table(spark, d, "part").select(of("p", c("p_partkey")).alias("id"), c("p_name").alias("name"))
    sources = table(spark, d, "customer").select(of("c", c("c_custkey")).alias("id"), lit("text").alias("source_type"))
    events = table(spark, d, "events").select(of("e", c("event_id")).alias("id"), of("s", c("user_id")).alias("media_id"), of("s", c("user_id")).alias("source_id"), c("event_type").alias("run_id"), c("props").alias("caption"), "ts", "event_id")
    seen = events.withColumn("source_id", F.when(c("event_id") % 3 != 0, c("source_id")).otherwise("other"))
    runs = events.where("run_id <> 'error'").groupBy("run_id").agg(F.max("ts").alias("finished_at"))
    rows = detail.recipe_detail(orders.select("id", "status"), links, lines.select(c("step").alias("id"), c("l_linenumber").alias("order"), lit("t").alias("text"), lit("x").alias("source_id")), sources, parts, media, seen, runs)
    joined = lambda column, *parts: F.array_join(F.transform(column, lambda x: F.concat(*[(F.coalesce(x[p].cast("string"), lit("")) if p != ":" else lit(":")) for p in parts])), ",")
    names = F.array_join(F.array_distinct(F.transform("ingredient_mentions", lambda x: x["name"])), ",")
    counts = [c(f"media.{n}").alias(n) for n in ("images", "videos", "downloaded_images", "downloaded_videos")]
    return rows.select(c("id").cast("long").alias("id"), c("recipe.status").alias("status"), joined("steps", "id").alias("steps"), joined("sources", "role", ":", "id").alias("sources"), names.alias("ingredients"), *counts, joined(c("media.inventory"), "id").alias("inventory"), joined("visual_evidence", "media_id", ":", "observation_id", ":", "step_order").alias("visual"))
