"""Aggregate, window, set and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, vectors
from ..operators import audit, evidence
from .registry import query, table


@query("SELECT o_orderstatus AS label, count(*) AS n FROM orders GROUP BY 1")
def q_counts_by_label(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("label")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_totalprice > 100000) AS large FROM orders")
def q_conditional_counts(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.count_if(F.col("o_totalprice") > 100000).alias("large"))


@query("SELECT l_returnflag AS flag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1")
def q_count_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"))


@query("SELECT conv_id, string_agg(turn || ':' || role, ',' ORDER BY turn, role, md5(text)) AS turns FROM conversations GROUP BY 1")
def q_ordered_collect(spark, d):
    rows = table(spark, d, "conversations").withColumn("h", F.md5(F.col("text").cast("binary")))
    listed = rows.groupBy("conv_id").agg(evidence.ordered_list(["turn", "role", "h"]).alias("x"))
    return listed.select("conv_id", F.array_join(F.transform("x", lambda t: F.concat_ws(":", t["turn"].cast("string"), t["role"])), ",").alias("turns"))


@query("SELECT o_orderpriority AS label, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS seen FROM orders GROUP BY 1")
def q_collect_distinct(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("seen"))


@query("""SELECT s.s_suppkey, coalesce(l.n, 0) AS n_lines, coalesce(p.n, 0) AS n_parts, n.n_name FROM supplier s LEFT JOIN (SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY 1) l ON s.s_suppkey = l.l_suppkey
LEFT JOIN (SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1) p ON s.s_suppkey = p.l_suppkey LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey""")
def q_branches_no_fanout(spark, d):
    supplier = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n_nationkey"))
    lines = table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey").groupBy("s_suppkey")
    out = evidence.branches(supplier, "s_suppkey", lines.agg(F.count("*").alias("n_lines")), lines.agg(F.countDistinct("l_partkey").alias("n_parts")), fill={"n_lines": 0, "n_parts": 0})
    return out.join(table(spark, d, "nation"), "n_nationkey", "left").select("s_suppkey", "n_lines", "n_parts", "n_name")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def q_best_per_group(spark, d):
    best = F.max_by("o_orderkey", F.struct("o_totalprice", -F.col("o_orderkey"))).alias("o_orderkey")
    return table(spark, d, "orders").groupBy("o_custkey").agg(best)


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type <> 'click' THEN ts END DESC NULLS LAST, event_id DESC) AS n FROM events) WHERE n = 1")
def q_latest_per_key(spark, d):
    finished = F.when(F.col("event_type") != "click", F.col("ts"))
    return evidence.first_by(table(spark, d, "events"), ["user_id"], finished.desc_nulls_last(), F.desc("event_id")).select("user_id", "event_id")


@query("SELECT l_orderkey, max(l_extendedprice) AS top, max(l_quantity) AS most FROM lineitem GROUP BY 1")
def q_max_per_group(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max("l_extendedprice").alias("top"), F.max("l_quantity").alias("most"))


@query("""WITH m AS (SELECT label, pos - 1 AS pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY 1, 2), n AS (SELECT label, sqrt(sum(m * m)) AS len FROM m GROUP BY 1)
SELECT label, pos::INTEGER AS pos, round(m / len, 6) AS x FROM m JOIN n USING (label)""")
def q_mean_unit_vector(spark, d):
    return vectors.mean_unit(table(spark, d, "embeddings"), "label", "embedding").select("label", "pos", F.round("x", 6).alias("x"))


@query("SELECT o_orderpriority AS label, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY 1")
def q_macro_median(spark, d):
    v = "o_totalprice"
    return table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.round(F.avg(v), 4).alias("mean"), F.round(F.median(v), 4).alias("median"), F.min(v).alias("low"), F.max(v).alias("high"))


@query("SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus))")
def q_grouping_sets(spark, d):
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, d, "orders").groupingSets([[s, p], [s]], s, p).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")).withColumnsRenamed({"o_orderstatus": "status", "o_orderpriority": "priority"})


@query("SELECT CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'high' ELSE o_orderpriority END AS bucket, round(avg((o_totalprice > 100000)::INTEGER), 6) AS rate FROM orders GROUP BY 1 UNION ALL SELECT 'all', round(avg((o_totalprice > 100000)::INTEGER), 6) FROM orders")
def q_pass_rate(spark, d):
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    buckets = F.array(F.when(high, "high").otherwise(F.col("o_orderpriority")), F.lit("all"))
    rows = table(spark, d, "orders").select(F.explode(buckets).alias("bucket"), (F.col("o_totalprice") > 100000).cast("int").alias("ok"))
    return rows.groupBy("bucket").agg(F.round(F.avg("ok"), 6).alias("rate"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def q_duplicates(spark, d):
    return audit.duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


_SUMS = "(sum(('0x' || substr(md5({0}), 1, 15))::BIGINT::HUGEINT))::VARCHAR || '-' || (sum(('0x' || substr(md5({0}), 17, 15))::BIGINT::HUGEINT))::VARCHAR"
_KEYED = " || ".join(f"coalesce(length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("p_partkey", "p_name", "p_brand", "p_type", "p_size"))


@query("SELECT count(*) AS n_rows, " + _SUMS.format("k") + f" AS content_hash FROM (SELECT {_KEYED} AS k FROM part)")
def q_content_hash(spark, d):
    return hashing.content_hash(table(spark, d, "part"), ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])


@query("SELECT o_orderstatus AS status, count(*) AS n_ids, " + _SUMS.format("k") + " AS set_hash FROM (SELECT DISTINCT o_orderstatus, o_custkey::VARCHAR AS k FROM orders) GROUP BY 1")
def q_id_set_hash(spark, d):
    return hashing.id_set_hash(table(spark, d, "orders").withColumnRenamed("o_orderstatus", "status"), "status", "o_custkey")


@query("SELECT n, count(*) AS owners FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) GROUP BY 1")
def q_histogram(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("owners"))


@query("SELECT min(n_chars) AS low, max(n_chars) AS high, sum(n_chars)::BIGINT AS total, round(avg(n_chars), 4) AS mean FROM documents")
def q_size_stats(spark, d):
    return table(spark, d, "documents").agg(F.min("n_chars").alias("low"), F.max("n_chars").alias("high"), F.sum("n_chars").alias("total"), F.round(F.avg("n_chars"), 4).alias("mean"))


@query("SELECT event_type, v AS key, sum(n)::BIGINT AS n FROM (SELECT event_type, user_id % 7 AS v, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT event_type, user_id % 7, count(*) FROM events WHERE value > 100 GROUP BY 1, 2) GROUP BY 1, 2")
def q_counter_merge(spark, d):
    events = table(spark, d, "events").withColumn("key", F.col("user_id") % 7)
    count = lambda df: df.groupBy("event_type", "key").agg(F.count("*").alias("n"))
    return count(events).unionByName(count(events.where("value > 100"))).groupBy("event_type", "key").agg(F.sum("n").alias("n"))


@query("SELECT user_id, event_id, lag(event_id) OVER w AS previous, lead(event_id) OVER w AS next FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def q_lead_lag(spark, d):
    return evidence.linked(table(spark, d, "events"), ["user_id"], "event_id", F.col("ts"), F.col("event_id")).select("user_id", "event_id", "previous", "next")


@query("""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events), g AS (SELECT *, CASE WHEN max(us) OVER w IS NULL OR us > max(us) OVER w + 21600000000 THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS island FROM g) SELECT user_id, island::BIGINT AS island, count(*) AS n, min(us) AS first, max(us) AS last FROM i GROUP BY 1, 2""")
def q_islands(spark, d):
    events = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    marked = evidence.islands(events, ["user_id"], "us", "us", F.lit(21_600_000_000), F.col("us"), F.col("event_id"))
    return marked.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("us").alias("first"), F.max("us").alias("last"))


@query("""WITH r AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS used FROM documents) SELECT source, doc_id, used::BIGINT AS used FROM r WHERE used <= 20000""")
def q_budget_prefix(spark, d):
    return evidence.within_budget(table(spark, d, "documents"), ["source"], "n_chars", 20000, F.col("doc_id")).select("source", "doc_id", "used")


@query("SELECT o_custkey, o_orderkey, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def q_topk_per_key(spark, d):
    return evidence.top_k(table(spark, d, "orders"), ["o_custkey"], 3, F.desc("o_totalprice"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "rank")


_CAPS = {"view": 1, "click": 3, "purchase": 2}


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n <= CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 3 WHEN 'purchase' THEN 2 ELSE 0 END")
def q_caps_per_kind(spark, d):
    return evidence.capped(table(spark, d, "events"), ["user_id"], "event_type", _CAPS, F.col("ts"), F.col("event_id")).select("user_id", "event_type", "event_id")


@query("SELECT conv_id, turn, 'E' || row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, md5(text)) AS evidence_id FROM conversations")
def q_evidence_ids(spark, d):
    rows = table(spark, d, "conversations").withColumn("h", F.md5(F.col("text").cast("binary")))
    return evidence.numbered(rows, ["conv_id"], F.col("turn"), F.col("role"), F.col("h")).select("conv_id", "turn", "evidence_id")


_AB = "WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 200000) "


def _two_sets(spark, d):
    ids = lambda test: table(spark, d, "orders").where(test).select(F.col("o_custkey").alias("id")).distinct()
    return ids("o_orderstatus = 'F'"), ids("o_totalprice > 200000")


@query(_AB + "SELECT id, bool_or(f = 'a') AS from_a, bool_or(f = 'b') AS from_b FROM (SELECT id, 'a' AS f FROM a UNION ALL SELECT id, 'b' FROM b) GROUP BY 1")
def q_union_flags(spark, d):
    a, b = _two_sets(spark, d)
    rows = a.withColumn("f", F.lit("a")).unionByName(b.withColumn("f", F.lit("b")))
    return rows.groupBy("id").agg(F.bool_or(F.col("f") == "a").alias("from_a"), F.bool_or(F.col("f") == "b").alias("from_b"))


@query(_AB + "SELECT id FROM a INTERSECT SELECT id FROM b")
def q_intersect(spark, d):
    a, b = _two_sets(spark, d)
    return a.intersect(b)


@query(_AB + "SELECT id FROM a EXCEPT SELECT id FROM b")
def q_except(spark, d):
    a, b = _two_sets(spark, d)
    return a.exceptAll(b)


@query(_AB + "SELECT only_a, only_b, only_a = 0 AND only_b = 0 AS equal FROM (SELECT count(*) FILTER (b.id IS NULL) AS only_a, count(*) FILTER (a.id IS NULL) AS only_b FROM a FULL JOIN b ON a.id = b.id)")
def q_set_equality(spark, d):
    return audit.same_ids(*_two_sets(spark, d), "id")


@query("SELECT p_name AS name, count(*) AS n FROM (SELECT p_name FROM part WHERE p_size > 25 UNION ALL SELECT p_name FROM part WHERE p_retailprice > 1000) GROUP BY 1")
def q_union_all(spark, d):
    part = table(spark, d, "part")
    return part.where("p_size > 25").select(F.col("p_name").alias("name")).unionByName(part.where("p_retailprice > 1000").select(F.col("p_name").alias("name"))).groupBy("name").agg(F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)) AS orphans, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')) AS out_of_scope, (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS repeated")
def q_anomaly_counts(spark, d):
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return audit.counts_row(orphans=audit.dangling(orders, lines, "o_orderkey"), out_of_scope=audit.dangling(lines, orders.where("o_orderstatus = 'F'"), "o_orderkey"), repeated=audit.duplicates(lines, ["o_orderkey", "l_linenumber"]))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 45)")
def q_dangling_edges(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return audit.dangling(lines, table(spark, d, "part").where("p_size <= 45"), "p_partkey").select("l_orderkey", "l_linenumber", F.col("p_partkey").alias("l_partkey"))


@query("SELECT vec_id, CASE r WHEN 1 THEN 'label' ELSE 'norm' END AS reason FROM (SELECT vec_id, unnest(list_filter([CASE WHEN label NOT BETWEEN 0 AND 7 THEN 1 END, CASE WHEN sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) NOT BETWEEN 0.99 AND 1.01 THEN 2 END], lambda x: x IS NOT NULL)) AS r FROM embeddings)")
def q_vector_violations(spark, d):
    return audit.violations(table(spark, d, "embeddings"), "vec_id", {"label": F.col("label").between(0, 7), "norm": vectors.valid(F.col("embedding"), 64)})


@query("SELECT conv_id, list_sort(list(turn)) IS NOT DISTINCT FROM range(0, count(*)) AS ok FROM conversations GROUP BY 1")
def q_permutation_check(spark, d):
    given = F.sequence(F.lit(0).cast("long"), F.count("*") - 1)
    return table(spark, d, "conversations").groupBy("conv_id").agg(audit.is_permutation(F.collect_list("turn"), given).alias("ok"))


@query("SELECT user_id, count(*) AS n FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before >= value GROUP BY 1")
def q_monotonicity_audit(spark, d):
    linked = evidence.linked(table(spark, d, "events"), ["user_id"], "value", F.col("ts"), F.col("event_id"))
    return linked.where("previous >= value").groupBy("user_id").agg(F.count("*").alias("n"))
