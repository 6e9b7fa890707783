"""Bundle, answer and audit queries: a user is a medium, an event a frame, its type and number are what it shows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import answers, audit, bundles, constraints, evidence, graph, metrics, retrieval
from ..runtime import saved
from ..streaming import windows
from . import retrieval_queries, text_queries
from .registry import query, table

# Fixed values of the queries: predicates that triples may have, and what ends relationships may have.
PREDICATES = {"near": "NEAR", "holds": "HOLDS"}
ENDPOINTS = {"HAS_FRAME": ({"Video"}, {"Frame"}), "BEFORE": ({"Frame"}, {"Frame"}), "SHOWS": ({"Frame"}, {"Object"}), "NEAR": ({"Object"}, {"Object"}), "HOLDS": ({"Object"}, {"Object"})}

_FRAMES = """WITH f AS (SELECT 'f' || event_id AS frame, 'u' || user_id AS owner, epoch_us(ts) AS us, event_type, json_extract_string(props, '$.k')::BIGINT AS k, event_id FROM events),
o AS (SELECT frame, owner, event_type AS name, frame || '.a' AS object_id FROM f UNION ALL SELECT frame, owner, 'k' || k % 5, frame || '.b' FROM f UNION ALL SELECT frame, owner, event_type, frame || '.c' FROM f WHERE k % 7 = 0),
t AS (SELECT 't' || event_id AS triple_id, frame, owner, CASE WHEN event_id % 11 = 0 THEN 'nobody' ELSE event_type END AS subject, CASE event_id % 3 WHEN 0 THEN 'near' WHEN 1 THEN 'holds' ELSE CASE WHEN event_id % 2 = 0 THEN 'near' ELSE 'likes' END END AS predicate, CASE WHEN event_id % 13 = 0 THEN event_type ELSE 'k' || k % 5 END AS object FROM f),
n AS (SELECT frame, name, count(DISTINCT object_id) AS n, min(object_id) AS id FROM o GROUP BY 1, 2),
r AS (SELECT t.*, CASE predicate WHEN 'near' THEN 'NEAR' WHEN 'holds' THEN 'HOLDS' END AS type, s.id AS start_id, e.id AS end_id, CASE WHEN predicate NOT IN ('near', 'holds') THEN 'unknown_predicate' WHEN s.n IS NULL THEN 'unknown_subject' WHEN s.n > 1 THEN 'ambiguous_subject' WHEN e.n IS NULL THEN 'unknown_object' WHEN e.n > 1 THEN 'ambiguous_object' WHEN s.id = e.id THEN 'self_loop' END AS reason
FROM t LEFT JOIN n s ON s.frame = t.frame AND s.name = subject LEFT JOIN n e ON e.frame = t.frame AND e.name = object),
d AS (SELECT *, dense_rank() OVER (PARTITION BY owner ORDER BY us) AS g FROM f), adj AS (SELECT a.owner, a.frame AS before, b.frame AS after FROM d a JOIN d b ON a.owner = b.owner AND b.g = a.g + 1),
rel AS (SELECT 'HAS_FRAME:' || owner || ':' || frame AS id, owner AS start_id, frame AS end_id, 'HAS_FRAME' AS type, owner FROM f UNION ALL SELECT 'BEFORE:' || before || ':' || after, before, after, 'BEFORE', owner FROM adj
UNION ALL SELECT 'SHOWS:' || frame || ':' || object_id, frame, object_id, 'SHOWS', owner FROM o UNION ALL SELECT 'triple:' || triple_id, start_id, end_id, type, owner FROM r WHERE reason IS NULL) """


def artifacts(spark, d):
    """frames, objects and triples of the events."""
    k = F.from_json("props", "k long").getField("k")
    rows = table(spark, d, "events").select(F.concat(F.lit("f"), "event_id").alias("frame"), F.concat(F.lit("u"), "user_id").alias("owner"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_type", k.alias("k"), "event_id")
    named = F.concat(F.lit("k"), F.col("k") % 5)
    object_of = lambda name, suffix: F.struct(name.alias("name"), F.concat("frame", F.lit(suffix)).alias("object_id"))
    every = F.array(object_of(F.col("event_type"), ".a"), object_of(named, ".b"), F.when(F.col("k") % 7 == 0, object_of(F.col("event_type"), ".c")))
    objects = rows.select("frame", F.explode(F.filter(every, lambda x: x.isNotNull())).alias("x")).select("frame", "x.*")
    n = F.col("event_id")
    predicate = F.when(n % 3 == 0, "near").when(n % 3 == 1, "holds").when(n % 2 == 0, "near").otherwise("likes")
    triples = rows.select(F.concat(F.lit("t"), n).alias("triple_id"), "frame", F.when(n % 11 == 0, "nobody").otherwise(F.col("event_type")).alias("subject"), predicate.alias("predicate"), F.when(n % 13 == 0, F.col("event_type")).otherwise(named).alias("object"))
    return rows.select("frame", "owner", "at"), objects, triples


@query(_FRAMES + "SELECT owner, before, after FROM adj")
def q_adjacent_pairs(spark, d):
    return bundles.adjacent_pairs(artifacts(spark, d)[0], "owner", "at", "frame")


@query(_FRAMES + "SELECT owner AS id, 'Video' AS label, owner, true AS reference FROM f GROUP BY ALL UNION ALL SELECT frame, 'Frame', owner, false FROM f UNION ALL SELECT object_id, 'Object', owner, false FROM o")
def q_bundle_nodes(spark, d):
    return bundles.build(*artifacts(spark, d), PREDICATES)[0]


@query(_FRAMES + "SELECT id, start_id, end_id, type, owner FROM rel")
def q_bundle_relationships(spark, d):
    return bundles.build(*artifacts(spark, d), PREDICATES)[1]


@query(_FRAMES + "SELECT triple_id, reason FROM r WHERE reason IS NOT NULL")
def q_bundle_rejections(spark, d):
    return bundles.build(*artifacts(spark, d), PREDICATES)[2]


@query(_FRAMES + """, nodes AS (SELECT owner AS id, 'Video' AS label, owner, true AS reference FROM f GROUP BY ALL UNION ALL SELECT frame, CASE WHEN event_id % 17 = 0 THEN 'Film' ELSE 'Frame' END, owner, false FROM f WHERE event_id % 19 <> 0 UNION ALL SELECT object_id, 'Object', CASE WHEN object_id LIKE '%5.b' THEN 'u?' ELSE owner END, false FROM o),
base AS (SELECT DISTINCT 'u' || user_id AS id, CASE WHEN user_id % 5 = 0 THEN 'Image' ELSE 'Video' END AS label FROM events UNION ALL SELECT 'f' || event_id, 'Old' FROM events WHERE event_id % 23 = 0),
e AS (SELECT rel.id, type, start_id, end_id, rel.owner, a.label AS sl, a.owner AS so, b.label AS el, b.owner AS eo FROM rel LEFT JOIN nodes a ON a.id = start_id LEFT JOIN nodes b ON b.id = end_id)
SELECT DISTINCT id, reason FROM (SELECT id, 'label' AS reason FROM nodes WHERE label NOT IN ('Video', 'Frame', 'Object') OR reference <> (label = 'Video')
UNION ALL SELECT nodes.id, 'unknown_reference' FROM nodes LEFT JOIN base USING (id) WHERE reference AND NOT coalesce(base.label = nodes.label, false) UNION ALL SELECT nodes.id, 'existing_id' FROM nodes JOIN base USING (id) WHERE NOT reference
UNION ALL SELECT id, 'dangling' FROM e WHERE sl IS NULL OR el IS NULL
UNION ALL SELECT id, 'endpoint_label' FROM e WHERE sl IS NOT NULL AND el IS NOT NULL AND NOT (CASE type WHEN 'HAS_FRAME' THEN sl = 'Video' AND el = 'Frame' WHEN 'BEFORE' THEN sl = 'Frame' AND el = 'Frame' WHEN 'SHOWS' THEN sl = 'Frame' AND el = 'Object' ELSE sl = 'Object' AND el = 'Object' END)
UNION ALL SELECT id, 'owner' FROM e WHERE sl IS NOT NULL AND el IS NOT NULL AND (so <> owner OR eo <> owner)
UNION ALL SELECT id, 'unattached' FROM nodes WHERE NOT reference AND id NOT IN (SELECT start_id FROM rel UNION SELECT end_id FROM rel))""")
def q_bundle_violations(spark, d):
    """The rules on a bundle that was spoilt: labels, owners, missing frames, references of another label, known ids."""
    frames, objects, triples = artifacts(spark, d)
    nodes, relationships, _ = bundles.build(frames, objects, triples, PREDICATES)
    n = F.regexp_extract("id", "^f([0-9]+)$", 1).try_cast("long")
    is_frame = F.col("label") == "Frame"
    nodes = nodes.where(~is_frame | (n % 19 != 0)).withColumns({"label": F.when(is_frame & (n % 17 == 0), "Film").otherwise(F.col("label")), "owner": F.when(F.col("id").endswith("5.b"), "u?").otherwise(F.col("owner"))})
    users = table(spark, d, "events").select("user_id").distinct().select(F.concat(F.lit("u"), "user_id").alias("id"), F.when(F.col("user_id") % 5 == 0, "Image").otherwise("Video").alias("label"))
    old = table(spark, d, "events").where("event_id % 23 = 0").select(F.concat(F.lit("f"), "event_id").alias("id"), F.lit("Old").alias("label"))
    times = frames.select(F.col("frame").alias("id"), "at")
    return bundles.bundle_violations(nodes, relationships, users.union(old), {"Frame", "Object"}, {"Video"}, ENDPOINTS, times)


@query("SELECT p_partkey, p_name, coalesce(s_name, 'new:' || p_name) AS id FROM part LEFT JOIN (SELECT 'cold widget' AS n, min(s_name) AS s_name FROM supplier) ON p_name = n")
def q_endpoint_resolution(spark, d):
    known = table(spark, d, "supplier").agg(F.min("s_name").alias("id")).select(F.lit("cold widget").alias("name"), "id")
    return bundles.resolved(table(spark, d, "part").select("p_partkey", "p_name"), "p_name", known, "new:")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN n = 1 THEN id END AS supplier, CASE WHEN n IS NULL THEN 'unknown' WHEN n > 1 THEN 'ambiguous' END AS supplier_reason FROM lineitem LEFT JOIN (SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS id FROM supplier GROUP BY 1) ON s_nationkey = l_partkey % 25")
def q_exactly_one_object(spark, d):
    wanted = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 25).cast("int").alias("s_nationkey"))
    return bundles.exactly_one(wanted, table(spark, d, "supplier"), ["s_nationkey"], "s_suppkey", "supplier").drop("s_nationkey")


_NAMES = (("the", "e1"), ("that", "e2"), ("then the", "e3"), ("der", "e4"), ("und", "e4"), ("elle", "e5"))
_WORDS = "[^\\p{L}\\p{N}''’-]+"


@query(f"SELECT DISTINCT doc_id, entity_id, alias FROM (SELECT doc_id, ' ' || regexp_replace(trim(regexp_replace(lower(text), '[\\s\\-‐‑–—]+', ' ', 'g')), '{_WORDS}', ' ', 'g') || ' ' AS t FROM documents), (VALUES {', '.join(f'{n}' for n in _NAMES)}) AS v(alias, entity_id) WHERE contains(t, ' ' || alias || ' ')")
def q_entity_candidates(spark, d):
    names = spark.createDataFrame(list(_NAMES), "alias string, entity_id string")
    return bundles.entity_candidates(table(spark, d, "documents"), "doc_id", ["text"], names)


@query("SELECT event_id, x.p AS predicate, x.o AS object, CASE WHEN value > 50 THEN 'candidate' ELSE 'unusable' END AS status FROM (SELECT event_id, value, unnest([{'p': 'HAS_TYPE', 'o': event_type}, {'p': 'HAS_K', 'o': json_extract_string(props, '$.k')}]) AS x FROM events) WHERE x.o IS NOT NULL")
def q_visual_triples(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.from_json("props", "k string").getField("k"))
    return bundles.visual_triples(rows, "event_id", {"event_type": "HAS_TYPE", "k": "HAS_K"}, F.col("value") > 50)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'make' WHEN doc_id % 5 = 0 THEN 'make' WHEN doc_id % 7 = 0 THEN 'reject' ELSE 'copy' END AS action FROM documents")
def q_observation_reuse(spark, d):
    """What an earlier run made of the same text is copied if it is in order; it lacks a third and had other texts for a fifth."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    earlier = docs.where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("doc_id") % 5 == 0, "other").otherwise(F.col("sha")).alias("sha"), (F.col("doc_id") % 7 != 0).alias("fine"))
    return bundles.reused(docs, earlier, "doc_id", "sha", F.col("fine")).select("doc_id", "action")


@query("""SELECT c_custkey::VARCHAR AS owner, n_name AS member, [c_custkey::VARCHAR, n_name] AS node_ids, ['LIVES_IN'] AS relations, NULL AS source FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT c_custkey::VARCHAR, r_name, [c_custkey::VARCHAR, n_nationkey::VARCHAR, r_name], ['LIVES_IN', 'PART_OF'], 'nation:' || n_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def q_evidence_paths(spark, d):
    customers = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("owner"), F.col("c_nationkey").cast("string").alias("middle"))
    nations = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("middle"), "n_name", "n_regionkey")
    direct = customers.join(nations, "middle").select("owner", F.col("n_name").alias("member"), F.lit("LIVES_IN").alias("type"))
    second = nations.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("middle", F.col("r_name").alias("member"), F.lit("PART_OF").alias("type"), F.concat(F.lit("nation:"), "middle").alias("source"))
    return bundles.paths(direct, customers.withColumn("type", F.lit("LIVES_IN")), second)


@query("""WITH m AS (SELECT l_orderkey, list(l_linestatus ORDER BY l_linenumber, l_partkey, l_linestatus) AS parts FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey, coalesce(parts, []) AS parts, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS p FROM orders LEFT JOIN m ON l_orderkey = o_orderkey)
SELECT o_orderkey || ':parts:' || (i - 1) AS triple_id, o_orderkey AS subject, 'HAS_PART' AS predicate, parts[i] AS object FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM o) UNION ALL SELECT o_orderkey || ':p', o_orderkey, 'priority', coalesce(p, 'unknown') FROM o""")
def q_evidence_triples(spark, d):
    lines = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_linestatus"))), lambda x: x["l_linestatus"])
    parts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(lines.alias("parts"))
    rows = table(spark, d, "orders").join(parts, "o_orderkey", "left").withColumn("p", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")))
    return bundles.evidence_triples(rows, "o_orderkey", {"parts": "HAS_PART"}, {"p": "priority"}, "unknown")


_CONTEXT = """WITH c AS (SELECT o_custkey AS question, o_orderkey AS owner, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders), s AS (SELECT l_orderkey AS owner, l_linenumber AS step, 'line ' || l_linenumber || ' of part ' || l_partkey AS text, l_suppkey % 9 <> 0 AS owned FROM lineitem),
f AS (SELECT question, rank, CASE WHEN count(step) = 0 THEN 'missing_steps' WHEN count(step) <> count(DISTINCT step) THEN 'repeated_step' WHEN count_if(NOT owned) > 0 THEN 'foreign_source' END AS fault FROM c LEFT JOIN s USING (owner) GROUP BY question, c.owner, rank), q AS (SELECT question, arg_min(fault, rank) FILTER (fault IS NOT NULL) AS fault FROM f GROUP BY 1),
r AS (SELECT question, rank, owner, step, text, 'E' || row_number() OVER (PARTITION BY question ORDER BY rank, step, text) AS evidence_id, sum(length(text)) OVER (PARTITION BY question) AS size FROM c JOIN s USING (owner)) """


@query(_CONTEXT + "SELECT question, rank, owner, step, text, evidence_id, coalesce(fault, CASE WHEN size > 900 THEN 'over_budget' END, 'ok') AS status FROM r JOIN q USING (question)")
def q_answer_context(spark, d):
    from pyspark.sql import Window

    orders = table(spark, d, "orders").select(F.col("o_custkey").alias("question"), F.col("o_orderkey").alias("owner"))
    candidates = orders.withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy("owner")))
    line = F.concat(F.lit("line "), "l_linenumber", F.lit(" of part "), "l_partkey")
    steps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("owner"), F.col("l_linenumber").alias("step"), line.alias("text"), (F.col("l_suppkey") % 9 != 0).alias("owned"))
    return answers.context(candidates, steps, 900)


@query("""WITH p AS (SELECT event_id AS answer_id, 1 AS place, event_id % 4 AS step, json_extract_string(props, '$.k')::BIGINT AS k, [event_id, event_id + 1, event_id + CASE WHEN event_id % 6 = 0 THEN 0 ELSE 2 END] AS c FROM events),
x AS (SELECT answer_id, place, step, k + CASE WHEN answer_id % 9 = 0 THEN 1000 ELSE 0 END AS k, c FROM p), ev AS (SELECT event_id, (event_id % 5)::BIGINT AS step, json_extract_string(props, '$.k')::BIGINT AS k FROM events),
h AS (SELECT answer_id, place, count_if(ev.event_id IS NULL) AS unknown, list(DISTINCT ev.step) AS steps, list(DISTINCT ev.k) AS held FROM (SELECT answer_id, place, unnest(list_distinct(c)) AS id FROM x) LEFT JOIN ev ON ev.event_id = id GROUP BY 1, 2)
SELECT answer_id, place, reason FROM (SELECT x.answer_id, x.place, unnest([CASE WHEN len(c) <> len(list_distinct(c)) THEN 'citations' END, CASE WHEN unknown > 0 THEN 'unknown_citation' END, CASE WHEN NOT list_contains(steps, x.step) THEN 'unsupported_step' END, CASE WHEN NOT list_contains(held, x.k) THEN 'unsupported_number' END]) AS reason FROM x JOIN h USING (answer_id, place)) WHERE reason IS NOT NULL""")
def q_answer_violations(spark, d):
    rows = table(spark, d, "events").withColumn("k", F.from_json("props", "k long").getField("k"))
    n = F.col("event_id")
    said = F.concat(F.lit("见第"), n % 4, F.lit("步，取 "), F.col("k") + F.when(n % 9 == 0, 1000).otherwise(0))
    cites = F.array(n.cast("string"), (n + 1).cast("string"), (n + F.when(n % 6 == 0, 0).otherwise(2)).cast("string"))
    paragraphs = rows.select(n.alias("answer_id"), F.lit(1).alias("place"), said.alias("text"), cites.alias("citations"))
    evidence = rows.select(n.cast("string").alias("evidence_id"), (n % 5).alias("step"), F.concat(F.lit("k is "), "k").alias("text"))
    return answers.answer_violations(paragraphs, evidence)


@query("""WITH s AS (SELECT o_custkey AS answer_id, o_orderkey AS place, o_orderkey - o_orderkey % 3 AS owner, CASE WHEN o_orderkey % 5 = 0 THEN [o_orderstatus, o_orderstatus] ELSE [o_orderstatus] END AS reasons, [o_orderkey * 10 + 1, o_orderkey * 10 + 2] AS c FROM orders),
e AS (SELECT DISTINCT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS owner, first(l_returnflag ORDER BY l_returnflag) AS kind FROM lineitem WHERE l_linenumber < 4 GROUP BY 1, 2),
h AS (SELECT answer_id, place, count_if(e.id IS NULL) AS unknown, count_if(e.owner <> s.owner) AS foreign_, list(DISTINCT kind) FILTER (kind IS NOT NULL) AS kinds FROM (SELECT *, unnest(list_distinct(c)) AS id FROM s) s LEFT JOIN e ON e.id = s.id GROUP BY 1, 2),
n AS (SELECT *, count(*) OVER (PARTITION BY answer_id, owner) AS times FROM s)
SELECT answer_id, place, reason FROM (SELECT n.answer_id, n.place, unnest([CASE WHEN times > 1 THEN 'repeated_owner' END, CASE WHEN len(reasons) > 1 OR reasons[1] = 'P' THEN 'reasons' END, CASE WHEN unknown > 0 THEN 'unknown_citation' END, CASE WHEN foreign_ > 0 THEN 'foreign_citation' END, CASE WHEN reasons[1] <> 'P' AND NOT list_contains(coalesce(kinds, []), CASE reasons[1] WHEN 'F' THEN 'R' ELSE 'N' END) THEN 'unsupported_reason' END]) AS reason FROM n JOIN h USING (answer_id, place)) WHERE reason IS NOT NULL""")
def q_selection_violations(spark, d):
    orders, n = table(spark, d, "orders"), F.col("o_orderkey")
    reasons = F.when(n % 5 == 0, F.array("o_orderstatus", "o_orderstatus")).otherwise(F.array("o_orderstatus"))
    selections = orders.select(F.col("o_custkey").alias("answer_id"), n.alias("place"), (n - n % 3).alias("owner"), reasons.alias("reasons"), F.array(n * 10 + 1, n * 10 + 2).alias("citations"))
    lines = table(spark, d, "lineitem").where("l_linenumber < 4").groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("evidence_id"), F.col("l_orderkey").alias("owner")).agg(F.min("l_returnflag").alias("kind"))
    return answers.selection_violations(selections, lines, {"F": "R", "O": "N"})


@query("""WITH s AS (SELECT l_orderkey, list(l_linenumber) AS l, count_if(l_suppkey % 2 = 0) AS n FROM lineitem GROUP BY 1), o AS (SELECT o_orderkey AS id, o_orderstatus AS st, l, coalesce(n, 0) AS n FROM orders LEFT JOIN s ON l_orderkey = o_orderkey)
SELECT id, reason FROM (SELECT id, unnest([CASE WHEN st = 'P' THEN 'no_title' END, CASE WHEN l IS NULL THEN 'no_steps' END, CASE WHEN len(l) <> len(list_distinct(l)) THEN 'repeated_step' END, CASE WHEN list_max(l) <> len(list_distinct(l)) THEN 'gap' END, CASE WHEN n = 0 THEN 'no_source' END]) AS reason FROM o) WHERE reason IS NOT NULL""")
def q_detail_contract(spark, d):
    steps = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list("l_linenumber").alias("steps"), F.count_if(F.col("l_suppkey") % 2 == 0).alias("n"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus").join(steps, "id", "left")
    return answers.detail_violations(rows, "id", "steps", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.col("n"))


@query("SELECT p_partkey, array_to_string(list_filter(['cold', 'Small', 'red', 'widget'], lambda m: contains(lower(p_name), lower(m))), ',') AS markers FROM part")
def q_quality_markers(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(answers.markers(F.col("p_name"), ["cold", "Small", "red", "widget"]), ",").alias("markers"))


_SAVED = retrieval_queries._RANKS + """, a AS (SELECT query_id, id, rank FROM rk WHERE method = 'plain' AND rank <= 50), b AS (SELECT query_id, id, rank FROM rk WHERE method = 'damped' AND rank <= 50),
u AS (SELECT query_id, id, a.rank AS bm25_rank, b.rank AS dense_rank, coalesce(1.0::DOUBLE / (60 + a.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS rrf FROM a FULL JOIN b USING (query_id, id)), w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS rank FROM u),
sv AS (SELECT query_id, id, rank + CASE WHEN id % 41 = 0 THEN 1 ELSE 0 END AS rank, bm25_rank, dense_rank, rrf + CASE WHEN id % 37 = 0 THEN 0.01 ELSE 0 END AS rrf FROM w),
lg AS (SELECT *, row_number() OVER o AS place, lag(rrf) OVER o AS pr, lag(id) OVER o AS pi FROM sv WINDOW o AS (PARTITION BY query_id ORDER BY rank, id)) """


@query(_SAVED + "SELECT query_id, id, reason FROM (SELECT query_id, id, unnest([CASE WHEN place <> rank THEN 'rank' END, CASE WHEN id % 37 = 0 THEN 'rrf' END, CASE WHEN pr < rrf - 1e-9 OR (abs(pr - rrf) <= 1e-9 AND pi > id) THEN 'order' END]) AS reason FROM lg) WHERE reason IS NOT NULL")
def q_ranking_audit(spark, d):
    """Saved rankings, some of which were spoilt, held against their own numbers."""
    from pyspark.sql import Window

    from ..operators import retrieval

    ranked, _ = retrieval_queries.marked_rankings(spark, d, 50)
    of = lambda m, out: ranked.where(F.col("method") == m).select("query_id", "id", F.col("rank").alias(out))
    rows = of("plain", "bm25_rank").join(of("damped", "dense_rank"), ["query_id", "id"], "full")
    rows = rows.withColumn("rrf", retrieval.reciprocal("bm25_rank") + retrieval.reciprocal("dense_rank"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "id")))
    spoilt = rows.withColumns({"rank": F.col("rank") + F.when(F.col("id") % 41 == 0, 1).otherwise(0), "rrf": F.col("rrf") + F.when(F.col("id") % 37 == 0, 0.01).otherwise(0.0)})
    return metrics.ranking_violations(spoilt, ["query_id"])


@query(retrieval_queries._RANKS + "SELECT method, query_id, 'precision' AS name, round(hits / 10.0::DOUBLE + 0.1, 6) AS saved, round(hits / 10.0::DOUBLE, 6) AS recomputed FROM pq JOIN nr USING (query_id) WHERE query_id % 100 = 0")
def q_metric_audit(spark, d):
    """Per-query metrics as they were saved (every second one of them wrong) against those of the rankings."""
    scores = saved(metrics.of_marked(*retrieval_queries.marked_rankings(spark, d, 10), 10, ["method"]))
    old = scores.withColumn("precision", F.col("precision") + F.when(F.col("query_id") % 100 == 0, 0.1).otherwise(0.0))
    out = metrics.metric_differences(old, scores, ["method", "query_id"], ["precision", "recall", "rr"])
    return out.withColumns({c: F.round(c, 6) for c in ("saved", "recomputed")})


GOLD_TERMS = ("the", "that", "then", "and", "der", "die", "und", "elle", "est", "les")
_GOLD = f"WITH g AS (SELECT doc_id AS id, t AS term FROM documents, (SELECT unnest([{', '.join(repr(t) for t in GOLD_TERMS)}]) AS t) WHERE regexp_matches(lower(text), '(^|[^a-z0-9_])' || t || '([^a-z0-9_]|$)')), p AS (SELECT a.term AS a, b.term AS b, count(*) AS n FROM g a JOIN g b ON a.id = b.id AND a.term < b.term GROUP BY 1, 2 HAVING count(*) BETWEEN 3 AND 5000) "


def gold_terms(spark, d):
    """(term, id): every text with each of the listed terms as a whole word."""
    found = F.array(*[F.when(text.contains_alias(F.col("text"), t), F.lit(t)) for t in GOLD_TERMS])
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("term"))


@query(_GOLD + "SELECT a, b, n FROM p")
def q_gold_pairs(spark, d):
    return metrics.gold_pairs(gold_terms(spark, d), 3, 5000)


@query(_GOLD + "SELECT a, b, x AS excluded, m AS n FROM (SELECT p.a, p.b, x, p.n, count(*) AS m FROM p JOIN g ga ON ga.term = p.a JOIN g gb ON gb.id = ga.id AND gb.term = p.b, (SELECT DISTINCT term AS x FROM g) WHERE x NOT IN (p.a, p.b) AND NOT EXISTS (SELECT 1 FROM g WHERE g.id = ga.id AND g.term = x) GROUP BY ALL) WHERE m BETWEEN 3 AND 5000 AND m < n")
def q_gold_exclusions(spark, d):
    found = gold_terms(spark, d)
    return metrics.gold_exclusions(found, metrics.gold_pairs(found, 3, 5000), 3, 5000)


@query(retrieval_queries._RANKS + """, l AS (SELECT method, query_id, list(id ORDER BY rank) AS ids FROM rk WHERE rank <= 10 GROUP BY 1, 2), m AS (SELECT method, query_id, hits, coalesce(1.0::DOUBLE / first, 0) AS rr FROM pq JOIN nr USING (query_id))
SELECT count_if(a.ids <> b.ids) AS changed_rankings, sum(len(list_filter(b.ids, lambda x: NOT list_contains(a.ids, x))))::BIGINT AS new_members, (SELECT count(*) FROM m x JOIN m y USING (query_id) WHERE x.method = 'plain' AND y.method = 'damped' AND (x.hits <> y.hits OR x.rr <> y.rr)) AS changed_metrics FROM l a JOIN l b USING (query_id) WHERE a.method = 'plain' AND b.method = 'damped'""")
def q_method_changes(spark, d):
    ranked, sizes = retrieval_queries.marked_rankings(spark, d, 10)
    scores = saved(metrics.of_marked(ranked, sizes, 10, ["method"]))
    of = lambda df, m: df.where(F.col("method") == m).drop("method")
    return metrics.changes(of(ranked, "plain"), of(ranked, "damped"), of(scores, "plain"), of(scores, "damped"), ["precision", "recall", "rr"])


@query("SELECT doc_id FROM documents WHERE NOT regexp_matches(text, 'AKIA[A-Z0-9]{16}|\\bsk-[A-Za-z0-9_-]{8,}|(?i:\\b(api_?key|password|secret|token)\\b[\"'']?\\s*[:=]\\s*[\"'']?[A-Za-z0-9+/_.=-]{6,})')")
def q_without_credentials(spark, d):
    return table(spark, d, "documents").where(~constraints.holds_credential(F.col("text"))).select("doc_id")


@query("SELECT conv_id, len(list_filter(list(role), lambda r: r = 'user')) AS n_user, count(*) AS n_turns FROM conversations GROUP BY 1")
def q_modality(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role")).alias("turns"))
    return turns.select("conv_id", F.size(constraints.of_kind(F.col("turns"), "role", ["user"])).cast("long").alias("n_user"), F.size("turns").cast("long").alias("n_turns"))


@query("SELECT doc_id, md5('seven:' || doc_id) AS shuffle_key FROM documents ORDER BY 2, 1 LIMIT 100")
def q_seeded_shuffle(spark, d):
    return constraints.shuffled(table(spark, d, "documents").select("doc_id"), "doc_id", "seven", 100)


@query("SELECT p_partkey, CASE WHEN lower(p_name) = 'cold widget' THEN 0 WHEN lower(p_type) = 'cold widget' OR lower(p_brand) = 'cold widget' OR p_size = 10 THEN 1 ELSE 2 END AS kind FROM part")
def q_kind_rank(spark, d):
    members = F.array("p_type", "p_brand", F.when(F.col("p_size") == 10, "Cold Widget"))
    return table(spark, d, "part").select("p_partkey", constraints.kind_rank(F.col("p_name"), "cold widget", members).alias("kind"))


@query("""WITH n AS (SELECT p_partkey AS id, p_size % 2 AS s FROM part), e AS (SELECT l_partkey AS a, (l_partkey + 1) % 200 AS b, l_linenumber % 2 AS s FROM lineitem) SELECT a AS start_id, b AS end_id, count(*) AS n FROM e WHERE s = 0 AND a IN (SELECT id FROM n WHERE s = 0) AND b IN (SELECT id FROM n WHERE s = 0) GROUP BY 1, 2""")
def q_in_scope(spark, d):
    nodes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 2).alias("scope"))
    edges = table(spark, d, "lineitem").select(F.col("l_partkey").alias("start_id"), ((F.col("l_partkey") + 1) % 200).alias("end_id"), (F.col("l_linenumber") % 2).alias("scope"))
    return constraints.in_scope(nodes, edges, {"scope": 0})[1].groupBy("start_id", "end_id").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_orderkey, list(DISTINCT lower(p_name)) AS names, list(DISTINCT lower(p_brand)) AS brands FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1) SELECT l_orderkey FROM m WHERE (list_contains(names, 'cold widget') OR list_contains(brands, 'cold widget')) AND NOT list_contains(list_concat(names, brands), 'brand#11')""")
def q_detail_recheck(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    details = lines.groupBy("l_orderkey").agg(F.collect_set("p_name").alias("names"), F.collect_set("p_brand").alias("brands"))
    return details.where(constraints.holds_names(F.col("names"), F.col("brands"), ["Cold  Widget"], ["BRAND#11"])).select("l_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus, c_mktsegment, p_brand, s_name FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) ON s_suppkey = l_suppkey")
def q_four_way(spark, d):
    """Every line with its order, customer, part and supplier, each where it is known."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    out = lines.join(table(spark, d, "orders").where("o_orderstatus <> 'P'"), F.col("o_orderkey") == F.col("l_orderkey"), "left").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"), "left")
    out = out.join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"), "left").join(table(spark, d, "supplier").where("s_suppkey % 2 = 0"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "o_orderstatus", "c_mktsegment", "p_brand", "s_name")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem JOIN (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem WHERE l_returnflag = 'R') ON p = l_partkey AND s = l_suppkey GROUP BY 1, 2")
def q_composite_join(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    returned = lines.where("l_returnflag = 'R'").select("l_partkey", "l_suppkey").distinct()
    return lines.join(returned, ["l_partkey", "l_suppkey"]).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT n.user_id, p.priority, count(e.user_id) AS n FROM (SELECT DISTINCT user_id FROM events) n, (SELECT unnest(['purchase', 'signup', 'none']) AS t, unnest([0, 1, 2]) AS priority) p LEFT JOIN events e ON e.user_id = n.user_id AND e.event_type = p.t GROUP BY 1, 2")
def q_param_lookup(spark, d):
    """Every user with each wanted kind in the order of the wish, also where there is none."""
    wanted = spark.createDataFrame([("purchase", 0), ("signup", 1), ("none", 2)], "event_type string, priority int")
    users = table(spark, d, "events").select("user_id").distinct().crossJoin(F.broadcast(wanted))  # three kinds
    counts = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return users.join(counts, ["user_id", "event_type"], "left").select("user_id", "priority", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT doc_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:12], ' ') AS terms FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\\s,，。;；、?？!！]+'), lambda x: x <> '') AS l FROM documents)")
def q_query_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(text.query_terms(F.col("text")), " ").alias("terms"))


@query("SELECT doc_id, CASE WHEN regexp_matches(lower(text), 'of\\s+the') THEN length(regexp_extract(lower(text), '(?s)^(.*?)of\\s+the', 1)) END::INTEGER AS a, CASE WHEN regexp_matches(lower(text), 'of\\s+the') THEN length(regexp_extract(lower(text), '(?s)^(.*?of\\s+the)', 1)) END::INTEGER AS b FROM documents")
def q_normalized_span(spark, d):
    span = text.normalized_span(F.col("text"), "Of  the")
    return table(spark, d, "documents").select("doc_id", span.alias("s")).select("doc_id", F.col("s.start").alias("a"), F.col("s.end").alias("b"))


@query("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, role, text) AS whole FROM (SELECT conv_id, -1 AS turn, '' AS role, 'conversation ' || conv_id AS text FROM conversations GROUP BY conv_id UNION ALL SELECT conv_id, turn, role, text FROM conversations) GROUP BY 1")
def q_title_and_steps(spark, d):
    turns = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x["text"])
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(turns.alias("steps"))
    return rows.select("conv_id", text.title_and_steps(F.concat(F.lit("conversation "), "conv_id"), F.col("steps")).alias("whole"))


@query("SELECT page_id, replace(url_encode(regexp_extract(url, '^https?://[^/]+/?(.*)$', 1) || ' ü'), '%2F', '/') AS quoted FROM pages")
def q_url_quoted(spark, d):
    path = F.regexp_extract("url", "^https?://[^/]+/?(.*)$", 1)
    return table(spark, d, "pages").select("page_id", text.url_quoted(F.concat(path, F.lit(" ü"))).alias("quoted"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def q_fenced_json(spark, d):
    fenced = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("see\n```json\n"), "props", F.lit("\n```\nend"))).otherwise(F.col("props"))
    return table(spark, d, "events").select("event_id", F.from_json(text.fenced_json(fenced), "k long").getField("k").alias("k"))


_UID = "'{0}:' || substr(sha256({1}), 1, 24)"
_RECORD, _STEP, _ENTITY = _UID.format("record", "doc_id::VARCHAR"), _UID.format("step", "doc_id || ':' || step"), _UID.format("entity", "kind || ':' || normalized_name")


def text_graph(spark, d):
    docs = table(spark, d, "documents")
    steps = docs.select(F.col("doc_id").alias("record"), F.posexplode(text.lines(F.col("text"))).alias("step", "text"))
    mentions = text_queries.document_mentions(spark, d).withColumnRenamed("doc_id", "record")
    return graph.text_graph(docs.select(F.col("doc_id").alias("record"), F.col("source").alias("title")), steps, mentions, {"tool": "USES_TOOL", "ingredient": "USES", "action": "HAS_ACTION"})


@query(text_queries._MENTIONS + f"SELECT {_RECORD} AS start_id, {_STEP} AS end_id, 'HAS_STEP' AS type FROM l UNION ALL SELECT DISTINCT {_STEP}, {_ENTITY}, CASE kind WHEN 'tool' THEN 'USES_TOOL' WHEN 'ingredient' THEN 'USES' ELSE 'HAS_ACTION' END FROM r")
def q_text_graph_edges(spark, d):
    return text_graph(spark, d)[1]


@query(text_queries._MENTIONS + "SELECT 'Record' AS label, count(*) AS n FROM documents UNION ALL SELECT 'Step', count(*) FROM l UNION ALL SELECT upper(kind[1]) || kind[2:], count(DISTINCT normalized_name) FROM r GROUP BY kind")
def q_text_graph_nodes(spark, d):
    return text_graph(spark, d)[0].groupBy("label").agg(F.count("*").alias("n"))


@query(text_queries._MENTIONS + f"SELECT DISTINCT {_RECORD} AS owner, upper(kind[1]) || kind[2:] AS kind, normalized_name AS name FROM r")
def q_candidate_index(spark, d):
    return graph.candidate_index(*text_graph(spark, d), "Record", "HAS_STEP")


@query(text_queries._MENTIONS + "SELECT 0::BIGINT AS missing, (SELECT count(*) FROM l)::BIGINT + (SELECT count(*) FROM (SELECT DISTINCT kind, normalized_name FROM r))::BIGINT AS unexpected, 0::BIGINT AS loose_edges, false AS complete")
def q_full_scope(spark, d):
    """The graph of the texts against their records alone: steps and names are what the list does not expect."""
    nodes, edges = text_graph(spark, d)
    return audit.scope_proof(nodes, edges, nodes.where("label = 'Record'"), "id")


@query(retrieval_queries._DENSE + "SELECT id, rank, source, orphan FROM (SELECT id, rank, source, doc_id IS NULL AS orphan, lang FROM (SELECT id, row_number() OVER (ORDER BY dense DESC, id) AS rank FROM den ORDER BY dense DESC, id LIMIT 50) LEFT JOIN (SELECT * FROM documents WHERE doc_id % 4 <> 0) ON doc_id = id) WHERE orphan OR lang <> 'de' ORDER BY rank LIMIT 10")
def q_visual_search(spark, d):
    """The nearest vectors with what is known of them; a quarter has no evidence, German ones are filtered after the search."""
    from pyspark.sql import Window

    best = retrieval.seeds(retrieval_queries.dense(spark, d), "dense", positive=False)
    ranked = best.select("id", F.row_number().over(Window.orderBy(F.desc("dense"), "id")).alias("rank"))  # fifty rows
    known = table(spark, d, "documents").where("doc_id % 4 <> 0").select(F.col("doc_id").alias("id"), "source", "lang")
    return retrieval.with_evidence(ranked, known, F.col("lang") != "de", 10).select("id", "rank", "source", "orphan")


@query("""WITH r AS (SELECT conv_id, turn, role, text, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC, role, md5(text) ROWS UNBOUNDED PRECEDING) AS used FROM conversations)
SELECT conv_id, turn, role, CASE WHEN used <= 500 THEN text ELSE right(text, (500 - (used - length(text)))::BIGINT) END AS text FROM r WHERE used - length(text) < 500""")
def q_truncated_history(spark, d):
    """The newest turns in 500 characters, the oldest of them cut at its beginning."""
    rows = table(spark, d, "conversations").withColumn("h", F.md5(F.col("text").cast("binary")))
    return evidence.newest_within(rows, ["conv_id"], "text", 500, F.desc("turn"), F.col("role"), F.col("h")).select("conv_id", "turn", "role", "text")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 100000 + l_partkey) - 1 AS n FROM lineitem) WHERE n <> l_linenumber - 1")
def q_misplaced(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_linenumber") - 1).alias("place"), (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("at"))
    return audit.misplaced(rows, ["l_orderkey"], "place", "at").select("l_orderkey", "l_linenumber", "l_partkey")


@query("SELECT vec_id, CASE WHEN vec_id % 40 = 0 THEN 'new' WHEN vec_id % 50 = 1 THEN 'gone' ELSE 'changed' END AS change FROM embeddings WHERE vec_id % 40 = 0 OR vec_id % 50 = 1 OR vec_id % 60 = 2")
def q_changed_vectors(spark, d):
    rows, n = table(spark, d, "embeddings").select("vec_id", "embedding"), F.col("vec_id")
    after = rows.where((n % 50 != 1) | (n % 40 == 0)).withColumn("embedding", F.when(n % 60 == 2, F.transform("embedding", lambda x: x + F.lit(1).cast("float"))).otherwise(F.col("embedding")))
    return audit.changed_values(rows.where(n % 40 != 0), after, "vec_id", ["embedding"])


@query("SELECT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'R')")
def q_composite_anti(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")
    return lines.join(lines.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"], "left_anti").select("l_orderkey", "l_partkey", "l_suppkey")


@query("SELECT p_partkey, p_name || CASE WHEN regexp_matches(p_name, '\\bcold\\b') THEN ' chilled iced' ELSE '' END || CASE WHEN regexp_matches(p_name, '\\bwidget\\b') THEN ' gadget' ELSE '' END AS asked FROM part")
def q_expanded_query(spark, d):
    return table(spark, d, "part").select("p_partkey", text.expanded_query(F.col("p_name"), {"cold": ["chilled", "iced"], "widget": ["gadget"]}).alias("asked"))


@query("SELECT user_id, event_type FROM (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS n FROM events) WHERE n = 1 AND epoch_us(ts) // 1000000 >= 1704067200 + 20 * 86400")
def q_latest_alive(spark, d):
    """The last event of each user, where it lies in the ten days before the thirtieth of the month."""
    rows = table(spark, d, "events").select("user_id", "ts", "event_type")
    return windows.latest_alive(rows, "user_id", "ts", 10 * 86400, 1704067200 + 30 * 86400).select("user_id", "event_type")


@query("""WITH n AS (SELECT event_id AS i, event_id % 12 AS k, ['VisualObservation', 'Frame', 'VideoClip', 'VisualObject'][event_id % 4 + 1] AS label FROM events)
SELECT 'n' || i AS id, r AS reason FROM (SELECT i, unnest(list_filter([CASE WHEN k = 5 THEN 'evidence' END, CASE WHEN k = 6 THEN 'evidence_binding' END, CASE WHEN k = 7 THEN 'verified' END, CASE WHEN k = 8 THEN 'confidence' END, CASE WHEN k = 8 AND label = 'VisualObservation' THEN 'embedding' END,
CASE WHEN k = 9 THEN 'similarity' END, CASE WHEN k = 9 AND label = 'Frame' THEN 'frame_time' END, CASE WHEN k = 10 THEN 'evidence_archive' END, CASE WHEN k = 10 AND label = 'VideoClip' THEN 'clip_times' END, CASE WHEN k = 11 THEN 'properties' END, CASE WHEN k = 4 THEN 'semantics' END, CASE WHEN k = 4 AND label = 'VisualObservation' THEN 'raw_output' END,
CASE WHEN k = 3 THEN 'source' END], lambda x: x IS NOT NULL)) AS r FROM n)""")
def q_evidence_json(spark, d):
    """Nodes of all events with their evidence as JSON, each twelfth spoilt in its own way."""
    from ..operators.embedded import evidence_violations

    scope = {"build_id": "b", "split": "test", "dataset_revision": "r"}
    k, user = F.col("event_id") % 12, F.col("user_id").cast("string")
    label = F.element_at(F.array(*[F.lit(x) for x in ("VisualObservation", "Frame", "VideoClip", "VisualObject")]), (F.col("event_id") % 4 + 1).cast("int"))
    spoilt = lambda n, bad, good: F.when(k == n, F.lit(bad)).otherwise(F.lit(good))
    medium, source = F.concat(F.lit("v"), user), F.concat(F.lit("s"), user)
    evidence = F.concat(F.lit('{"source_media_id": "'), F.when(k == 6, F.lit("other")).otherwise(medium), F.lit('", "source_id": "'), F.when(k == 3, F.lit("s-none")).otherwise(source), F.lit('", "split": "test", "archive": "'), spoilt(10, "b.zip", "a.zip"), F.lit('"}'))
    fields = {
        "source_media_id": F.concat(F.lit('"'), medium, F.lit('"')), "source_id": F.when(k == 3, F.lit('"s-none"')).otherwise(F.concat(F.lit('"'), source, F.lit('"'))),
        "evidence_json": F.when(k == 5, F.lit('"[1]"')).otherwise(F.concat(F.lit('"'), F.replace(evidence, F.lit('"'), F.lit('\\"')), F.lit('"'))),
        "verified": spoilt(7, '"false"', "false"), "confidence": spoilt(8, "0.5", "null"), "similarity_score": spoilt(9, "1.5", "0.25"), "semantics": spoilt(4, '"fact"', '"model_candidate"'), "model": F.lit('"m"'),
        "embedding": spoilt(8, "[1, true, 2]", "[0, 0.5, 2]"), "embedding_model": F.lit('"e"'), "raw_json": spoilt(4, '"[]"', '"{}"'),
        "timestamp_seconds": spoilt(9, '"1"', "1.5"), "start_seconds": F.lit("1"), "end_seconds": spoilt(10, "1", "2.5"),
    }
    parts = []
    for name, value in fields.items():
        parts += [F.lit(f'{", " if parts else ""}"{name}": '), value]
    json = F.when(k == 11, F.lit("{broken")).otherwise(F.concat(F.lit("{"), *parts, F.lit("}")))
    events = table(spark, d, "events")
    nodes = events.select(F.concat(F.lit("n"), "event_id").alias("id"), label.alias("label"), json.alias("properties_json"))
    users = events.select(user.alias("u")).distinct()
    media = users.select(F.concat(F.lit("v"), "u").alias("id"), F.lit("Video").alias("label"), F.concat(F.lit("s"), "u").alias("source_id"))
    none = F.lit(None).cast("string")
    sources = users.select(F.concat(F.lit("s"), "u").alias("id"), F.lit("a.zip").alias("archive"), F.concat(F.lit("m/"), "u").alias("member"), none.alias("artifact_path"), none.alias("url"), *[F.lit(v).alias(c) for c, v in scope.items()])
    return evidence_violations(nodes, media, sources, scope, dimensions=3)
