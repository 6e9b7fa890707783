"""Work and storage: queues of items, publication in commits, archives read by spans."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from ..sources import archives, builds
from ..sources.commits import CommitLog
from ..streaming.queue import ItemQueue
from .registry import query, table
from .source_queries import place


def _checked(payload: str | None, attempt: int) -> str:
    """A worker that never takes texts with an address, and some others only at their second or third attempt."""
    if payload is None or "@" in payload:
        raise ValueError("address")
    if len(payload) % 3 >= attempt:
        raise RuntimeError(f"not at {attempt}")
    return hashlib.md5(payload.encode()).hexdigest()


@query("""SELECT doc_id::VARCHAR AS id, CASE WHEN refused THEN 'parked' ELSE 'verified' END AS status, CASE WHEN refused THEN 3 ELSE length(text) % 3 + 1 END AS attempts,
CASE WHEN refused THEN 'ValueError: address' END AS error, CASE WHEN NOT refused THEN md5(text) END AS result, CASE WHEN refused THEN 'parked' ELSE 'verified' END AS state, CASE WHEN refused THEN 3 ELSE length(text) % 3 + 1 END AS n_published
FROM (SELECT *, coalesce(contains(text, '@'), true) AS refused FROM documents)""")
def q_work_queue(spark, d):
    """A stream of all documents through a queue: each item's last attempt beside the state in the checkpoint."""
    queue = ItemQueue(spark, place(spark), _checked)
    schema = table(spark, d, "documents").schema
    queue.drain(lambda: spark.readStream.schema(schema).parquet(f"{d}/documents.parquet*"), "doc_id", "text")  # a pattern: streams take no single file
    state = queue.state().select("id", F.col("status").alias("state"))
    return queue.status().join(state, "id").join(queue.attempts().groupBy("id").agg(F.count("*").alias("n_published")), "id")


@query("SELECT c_custkey, c_name, count(o_orderkey) AS n_orders, 'refused' AS same_name, true AS first_batch, false AS same_batch, 'refused' AS other_batch, 'refused' AS stale_snapshot FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2")
def q_publication(spark, d):
    """Two tables in one commit; then a taken name, a repeated batch, another payload for it, and a stale writer."""
    customers, orders = table(spark, d, "customer").select("c_custkey", "c_name"), table(spark, d, "orders").select("o_orderkey", "o_custkey")

    def refused(act):
        try:
            act()
        except builds.BuildError:
            return "refused"
        return "accepted"

    store, log = builds.Builds(spark, place(spark)), CommitLog(spark, place(spark))
    store.publish("all", {"customers": customers, "orders": orders})
    same_name = refused(lambda: store.publish("all", {"customers": customers.limit(1)}))
    first, again = log.publish_batch("run", 0, {"orders": orders}), log.publish_batch("run", 0, {"orders": orders.repartition(3)})
    other = refused(lambda: log.publish_batch("run", 0, {"orders": orders.where("o_orderkey % 2 = 0")}))
    base = log.replace_all("load", {"customers": customers.limit(2)})
    log.replace_all("load", {"customers": customers, "orders": log.batches("orders", "run").drop("batch")}, base)
    stale = refused(lambda: log.replace_all("load", {"customers": customers.limit(3)}, base))
    now = log.snapshot()
    kept = now["customers"].join(store.read(table="customers"), ["c_custkey", "c_name"])
    counted = now["orders"].join(store.read(table="orders"), ["o_orderkey", "o_custkey"]).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_orders"))
    outcome = {"same_name": same_name, "first_batch": first, "same_batch": again, "other_batch": other, "stale_snapshot": stale}
    return kept.join(counted, "c_custkey", "left").fillna(0, "n_orders").withColumns({k: F.lit(v) for k, v in outcome.items()})


@query("SELECT doc_id, source || '-' || (doc_id % 4) AS archive, strlen(text) AS size, md5(text) AS sum, true AS in_order FROM documents")
def q_archive_members(spark, d):
    """All texts as members of ZIP files, read back by spans of 20 kB."""
    path = place(spark)
    docs = table(spark, d, "documents").select(F.concat("source", F.lit("-"), F.col("doc_id") % 4).alias("archive"), F.concat(F.lit("texts/"), F.col("doc_id"), F.lit(".txt")).alias("member"), "text")
    archives.write_archives(docs, path, "archive", "member", "text").collect()  # a row an archive
    rows = archives.members(spark, path, span_bytes=20_000)
    return rows.where("fault IS NULL").select(F.regexp_extract("member", r"(\d+)\.txt$", 1).cast("long").alias("doc_id"), F.regexp_extract("archive", r"([^/]*)\.zip$", 1).alias("archive"), "size", F.md5("content").alias("sum"), (F.col("entry_end") > F.col("header_offset") + F.col("compressed_size")).alias("in_order"))


_RANGES = """WITH RECURSIVE m AS (SELECT l_orderkey AS a, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, l_linenumber * 1000 AS s, l_linenumber * 1000 + 100 + max(l_quantity)::BIGINT * 18 AS e, max(l_returnflag) <> 'R' AS want, max(l_linestatus) = 'F' AS meta FROM lineitem GROUP BY l_orderkey, l_linenumber),
r AS (SELECT a, i, CASE WHEN want THEN s END AS first, CASE WHEN want THEN e END AS last, CASE WHEN want THEN 1 ELSE 0 END AS n, CASE WHEN want THEN 1 ELSE 0 END AS part, false AS blocked FROM m WHERE i = 1
UNION ALL SELECT m.a, m.i, CASE WHEN NOT m.want THEN r.first WHEN joins THEN r.first ELSE s END, CASE WHEN m.want THEN e ELSE r.last END, CASE WHEN NOT m.want THEN r.n WHEN joins THEN r.n + 1 ELSE 1 END, r.part + CASE WHEN m.want AND NOT joins THEN 1 ELSE 0 END, CASE WHEN m.want THEN false ELSE r.blocked OR NOT m.meta END
FROM r JOIN m ON m.a = r.a AND m.i = r.i + 1, LATERAL (SELECT coalesce(NOT r.blocked AND s - r.last - 1 <= 700 AND e - r.first + 1 <= 2600, false) AS joins) AS j)
SELECT a::VARCHAR AS archive, max(first) AS first, max(last) AS last, max(n)::BIGINT AS n_members FROM r WHERE part > 0 GROUP BY a, part"""


@query(_RANGES)
def q_read_spans(spark, d):
    """Byte ranges for wanted members, with metadata and other members between them."""
    start = F.col("l_linenumber").cast("long") * 1000
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("size"), F.max("l_returnflag").alias("flag"), F.max("l_linestatus").alias("status"))
    rows = lines.select(F.col("l_orderkey").alias("archive"), start.alias("header_offset"), (start + 100 + F.col("size").cast("long") * 18).alias("entry_end"), "flag", "status")
    return archives.read_spans(rows, F.col("flag") != "R", F.col("status") == "F", 700, 2600)


@query("""WITH p AS (SELECT p_partkey, p_partkey % 5 AS k, split_part(p_name, ' ', 2) AS w, p_size AS n FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN w WHEN 1 THEN 'rope' WHEN 2 THEN 'rope' WHEN 3 THEN 'rope' ELSE '' END AS available, CASE WHEN k = 1 THEN w ELSE '' END AS excluded, CASE WHEN k IN (2, 4) THEN w ELSE '' END AS unavailable,
CASE WHEN k = 0 THEN n::DOUBLE WHEN k = 1 THEN 60.0 WHEN k = 3 THEN 30.0 END AS at_most, k = 4 AS allow_missing FROM p""")
def q_question_plans(spark, d):
    """A question for each part, in five forms: wished, excluded, out of stock, wished besides what is owned, missing."""
    from ..operators import questions

    word, k = F.split_part("p_name", F.lit(" "), F.lit(2)), F.col("p_partkey") % 5
    forms = [F.concat(F.lit("Make something of "), word, F.lit(" in "), F.col("p_size"), F.lit(" minutes")), F.concat(F.lit("I have a rope, without "), word, F.lit(", within 1 hour")), F.concat(F.lit("我有绳子，"), word, F.lit("还没买")), F.concat(F.lit("I have rope, want a "), word, F.lit(" in half an hour")), F.concat(F.lit("We are out of "), word, F.lit("; we may buy it"))]
    asked = table(spark, d, "part").select("p_partkey", F.element_at(F.array(*forms), (k + 1).cast("int")).alias("question"))
    aliases = {w: w for w in ("widget", "bolt", "gear", "valve", "panel", "bracket", "nut", "screw", "pipe", "rope")} | {"绳子": "rope"}
    aliases |= {r.w: r.w for r in table(spark, d, "part").select(word.alias("w")).distinct().collect() if r.w}  # the kinds of parts: a few
    joined = lambda c: F.array_join(F.col(f"plan.{c}"), ",").alias(c)
    return questions.planned(asked, "question", aliases).select("p_partkey", joined("available"), joined("excluded"), joined("unavailable"), "plan.at_most", "plan.allow_missing")
