"""Constraint and graph queries: an order is an entity with parts as members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import audit, constraints, evidence, graph, matching, timeline
from .registry import query, table

COLOURS = ("red", "blue")


def baskets(spark: SparkSession, d: str) -> DataFrame:
    """Orders with the distinct names of their parts, tags and value."""
    names = table(spark, d, "lineitem").select("l_orderkey", "l_partkey").distinct().join(table(spark, d, "part").select("p_partkey", "p_name", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    members = names.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("p_name")).alias("members"), F.sort_array(F.collect_set("p_brand")).alias("extras"))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"), F.array("o_orderpriority", "o_orderstatus").alias("tags"), F.col("o_orderpriority").alias("name"))
    empty = F.array().cast("array<string>")
    return orders.join(members, F.col("id") == F.col("l_orderkey"), "left").select("id", "value", "tags", "name", F.coalesce("members", empty).alias("members"), F.coalesce("extras", empty).alias("extras"))


_BASKETS = """WITH m AS (SELECT l_orderkey, list_sort(list(DISTINCT p_name)) AS members, list_sort(list(DISTINCT p_brand)) AS extras FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
b AS (SELECT o_orderkey AS id, o_totalprice AS value, [o_orderpriority, o_orderstatus] AS tags, o_orderpriority AS name, coalesce(members, []) AS members, coalesce(extras, []) AS extras FROM orders LEFT JOIN m ON o_orderkey = l_orderkey) """


def edges(spark: SparkSession, d: str) -> DataFrame:
    """(order_id, part_name), each once."""
    parts = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("part_name"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), "l_partkey").join(parts, F.col("l_partkey") == F.col("p_partkey")).select("order_id", "part_name").distinct()


_EDGES = "WITH e AS (SELECT DISTINCT l_orderkey AS order_id, p_name AS part_name FROM lineitem JOIN part ON l_partkey = p_partkey) "


def some_names(spark, d, n):
    """The first names of parts, as a query's inventory."""
    return [r[0] for r in table(spark, d, "part").select("p_name").distinct().orderBy("p_name").limit(n).collect()]


@query(_BASKETS + "SELECT id FROM b WHERE NOT list_has_any(list_concat(members, extras), (SELECT [min(p_name), 'Brand#11'] FROM part))")
def q_exclusion(spark, d):
    c = (some_names(spark, d, 1)[0], "Brand#11")
    return baskets(spark, d).where(constraints.excludes(F.col("members"), F.col("extras"), c)).select("id")


@query("SELECT o_orderkey AS id, nullif(o_orderstatus, 'P') IS NULL AS unknown FROM orders WHERE coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END <= 20000, false)")
def q_null_safe_upper_bound(spark, d):
    value = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    return table(spark, d, "orders").where(constraints.at_most(value, 20000.0)).select(F.col("o_orderkey").alias("id"), value.isNull().alias("unknown"))


@query(_BASKETS + "SELECT id FROM b WHERE len(list_filter(['1-URGENT', 'F'], lambda x: NOT list_contains(tags, x))) = 0")
def q_required_tags(spark, d):
    return baskets(spark, d).where(constraints.has_all(F.col("tags"), ("1-URGENT", "F"))).select("id")


@query(_BASKETS + ", inv AS (SELECT list(p) AS have FROM (SELECT DISTINCT p_name AS p FROM part ORDER BY 1 LIMIT 30)) SELECT id, len(members) AS n_members FROM b, inv WHERE len(list_filter(members, lambda x: NOT list_contains(have, x))) = 0")
def q_inventory_subset(spark, d):
    have = some_names(spark, d, 30)
    return baskets(spark, d).where(F.size(constraints.missing(F.col("members"), have)) == 0).select("id", F.size("members").cast("long").alias("n_members"))


@query(_BASKETS + """, inv AS (SELECT list(p) AS have FROM (SELECT DISTINCT p_name AS p FROM part ORDER BY 1 LIMIT 30)),
r AS (SELECT id, len(list_filter(members, lambda x: NOT list_contains(have, x))) AS missing, len(list_filter(members, lambda x: list_contains(have, x))) AS matched, value FROM b, inv WHERE NOT list_contains(extras, 'Brand#11') AND value <= 150000 AND list_contains(tags, 'O'))
SELECT id, missing, matched FROM r ORDER BY missing, matched DESC, coalesce(value, 10000), id LIMIT 50""")
def q_eligible_ranked(spark, d):
    c = constraints.Constraints(tuple(some_names(spark, d, 30)), ("Brand#11",), 150000.0, ("O",), allow_missing=True, top_k=50)
    col = F.col
    rows = baskets(spark, d).where(constraints.eligible(c, members=col("members"), extras=col("extras"), value=col("value"), tags=col("tags"), name=col("name")))
    return constraints.ranked(rows, c, "members", "value", "id").select("id", col("missing").cast("long"), col("matched").cast("long"))


@query(_EDGES + ", t AS (SELECT p, row_number() OVER (ORDER BY p) AS k FROM (SELECT DISTINCT p_name AS p FROM part)) SELECT order_id FROM e JOIN t ON part_name = p WHERE k <= 20 GROUP BY 1 HAVING count(DISTINCT CASE WHEN k <= 10 THEN 1 ELSE 2 END) = 2")
def q_division_all_terms(spark, d):
    n = some_names(spark, d, 20)
    return constraints.division(edges(spark, d), "order_id", "part_name", {"first": n[:10], "second": n[10:]})


@query(_EDGES + "SELECT DISTINCT order_id FROM e WHERE order_id NOT IN (SELECT order_id FROM e WHERE part_name IN (SELECT p FROM (SELECT DISTINCT p_name AS p FROM part ORDER BY 1 LIMIT 10)))")
def q_none_terms(spark, d):
    e = edges(spark, d)
    return constraints.without(e.select("order_id").distinct(), e, "order_id", "part_name", some_names(spark, d, 10))


@query(_EDGES + "SELECT o_orderkey AS id FROM orders WHERE contains(lower(o_orderpriority), 'urgent') OR o_orderkey IN (SELECT order_id FROM e WHERE part_name = (SELECT min(p_name) FROM part))")
def q_keyword_or_edge(spark, d):
    hit = edges(spark, d).where(F.col("part_name") == some_names(spark, d, 1)[0]).select(F.col("order_id").alias("o_orderkey"), F.lit(True).alias("hit"))
    return table(spark, d, "orders").join(hit, "o_orderkey", "left").where(F.lower("o_orderpriority").contains("urgent") | F.col("hit")).select(F.col("o_orderkey").alias("id"))


@query("SELECT p_partkey AS id, CASE WHEN lower(p_name) = (SELECT lower(min(p_name)) FROM part) THEN 0 WHEN contains(lower(p_name), split_part((SELECT lower(min(p_name)) FROM part), ' ', 1)) THEN 1 ELSE 2 END AS level FROM part ORDER BY level, lower(p_name), id LIMIT 40")
def q_title_rank(spark, d):
    first = some_names(spark, d, 1)[0].lower()
    part = table(spark, d, "part")
    level = F.when(F.lower("p_name") == first, 0).when(constraints.title_rank(F.col("p_name"), first.split(" ")[0]) < 2, 1).otherwise(2)
    return part.select(F.col("p_partkey").alias("id"), level.cast("int").alias("level"), F.lower("p_name").alias("n")).orderBy("level", "n", "id").limit(40).drop("n")


@query("SELECT event_id AS id, coalesce(nullif(CASE WHEN event_type = 'view' THEN '' ELSE event_type END, ''), props) AS label FROM events")
def q_first_nonnull(spark, d):
    blank = F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), constraints.first_present(blank, F.col("props"), blank_is_null=True).alias("label"))


@query("SELECT c_custkey AS id, array_to_string(list_filter([CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_mktsegment = 'BUILDING' THEN 'segment' END, CASE WHEN c_nationkey > 20 THEN 'nation' END], lambda x: x IS NOT NULL), ',') AS reasons FROM customer")
def q_invalid_reason_codes(spark, d):
    rules = {"negative": F.col("c_acctbal") < 0, "segment": F.col("c_mktsegment") == "BUILDING", "nation": F.col("c_nationkey") > 20}
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.array_join(constraints.reasons(rules), ",").alias("reasons"))


@query("SELECT page_id, regexp_matches(lower(url), '^https?://[^/@\\s]+(/[^\\s]*)?$') AS valid FROM pages")
def q_url_valid(spark, d):
    return table(spark, d, "pages").select("page_id", text.url_valid(F.col("url")).alias("valid"))


@query("SELECT o_custkey AS owner, l_partkey AS member FROM orders JOIN lineitem ON o_orderkey = l_orderkey UNION SELECT c_custkey, c_nationkey FROM customer")
def q_traverse_2hop(spark, d):
    first = table(spark, d, "orders").select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("middle"))
    second = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("middle"), F.col("l_partkey").alias("member"))
    direct = table(spark, d, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_nationkey").cast("long").alias("member"))
    return graph.rolled_up(first, second, direct)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def q_semi(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def q_anti(spark, d):
    return audit.dangling(table(spark, d, "orders"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey").select("o_orderkey")


@query("SELECT o_orderkey, count(l_partkey) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def q_left_orphans(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"))
    return evidence.branches(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", lines, fill={"n_lines": 0})


@query("SELECT o_orderkey, count(l_partkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1 HAVING count(l_partkey) <> 1")
def q_exactly_once(spark, d):
    return audit.exactly_once(table(spark, d, "orders"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


_UNIQUE = """WITH c AS (SELECT s_suppkey AS k, s_nationkey AS g, s_name AS owner FROM supplier WHERE s_suppkey % 3 = 0), one AS (SELECT g, min(owner) AS owner FROM c GROUP BY g HAVING count(DISTINCT owner) = 1)
SELECT s.s_suppkey AS k, coalesce(c.owner, one.owner) AS owner, CASE WHEN c.owner IS NOT NULL THEN 'exact' WHEN one.owner IS NOT NULL THEN 'group' ELSE 'none' END AS method FROM supplier s LEFT JOIN c ON s.s_suppkey = c.k LEFT JOIN one ON s.s_nationkey = one.g"""


@query(_UNIQUE)
def q_unique_candidate_fallback(spark, d):
    items = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("g"), F.col("s_name").alias("owner"))
    return graph.unique_owner(items.drop("owner"), items.where("k % 3 = 0"), "k", "g", "owner").select("k", "owner", "method")


@query("SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(trim(regexp_replace(lower(d.text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(b.text), '\\s+', ' ', 'g')))")
def q_containment_join(spark, d):
    """Passages meet the texts that hold the rarest of their inner words, short ones are found by an automaton."""
    return matching.contained(table(spark, d, "benchmark"), "item_id", "text", table(spark, d, "documents"), "doc_id", "text")


@query("SELECT page_id, p_partkey FROM pages JOIN (SELECT p_partkey, split_part(p_name, ' ', 1) AS w FROM part) ON contains(trim(regexp_replace(lower(html), '\\s+', ' ', 'g')), w)")
def q_short_passages(spark, d):
    """One-word passages in all pages, by automaton: they may begin and end inside of words."""
    words = table(spark, d, "part").select("p_partkey", F.split_part("p_name", F.lit(" "), F.lit(1)).alias("w"))
    return matching.contained(words, "p_partkey", "w", table(spark, d, "pages"), "page_id", "html").select("page_id", "p_partkey")


_RANGE = "WITH p AS (SELECT user_id, event_id, epoch(ts) AS at FROM events), r AS (SELECT user_id, event_id AS purchase_id, epoch(ts) - 3600 AS lo, epoch(ts) AS hi FROM events WHERE event_type = 'purchase') "


@query(_RANGE + "SELECT p.event_id, r.purchase_id FROM p JOIN r ON p.user_id = r.user_id AND p.at BETWEEN r.lo AND r.hi")
def q_range_join(spark, d):
    points = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).select("user_id", "event_id", (F.col("us") / 1e6).alias("at"))
    ranges = table(spark, d, "events").where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("hi")).withColumn("lo", F.col("hi") - 3600)
    return timeline.in_ranges(points, ranges, "user_id", "at", "lo", "hi", 3600.0).select("event_id", "purchase_id")


@query("""WITH v AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view'), p AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'purchase')
SELECT event_id, view_id FROM (SELECT p.event_id, v.event_id AS view_id, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(epoch_us(v.ts) - epoch_us(p.ts)), v.ts, v.event_id) AS n FROM p JOIN v USING (user_id) WHERE abs(epoch_us(v.ts) - epoch_us(p.ts)) <= 86400000000) WHERE n = 1""")
def q_nearest_event(spark, d):
    events = table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    day = 86_400_000_000
    views = events.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("us").alias("at"))
    buys = events.where("event_type = 'purchase'").select("user_id", "event_id", (F.col("us") - day).alias("lo"), (F.col("us") + day).alias("hi"), "us")
    near = timeline.in_ranges(views, buys, "user_id", "at", "lo", "hi", float(day))
    return evidence.top_k(near, ["event_id"], 1, F.abs(F.col("at") - F.col("us")), F.col("at"), F.col("view_id")).select("event_id", "view_id")


_GRAPH = """WITH n AS (SELECT DISTINCT 'nation:' || substr(sha256(n_name), 1, 24) AS id, 'nation' AS label, n_name AS name FROM nation UNION SELECT DISTINCT 'region:' || substr(sha256(r_name), 1, 24), 'region', r_name FROM region),
g AS (SELECT DISTINCT 'nation:' || substr(sha256(n_name), 1, 24) AS start_id, 'region:' || substr(sha256(r_name), 1, 24) AS end_id, 'IN_REGION' AS type FROM nation JOIN region ON n_regionkey = r_regionkey) """


def world(spark, d):
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    both = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    nodes = graph.nodes_of(nation, "nation", F.col("n_name")).union(graph.nodes_of(region, "region", F.col("r_name")))
    return nodes, graph.edges_of(both, ("nation", F.col("n_name")), "IN_REGION", ("region", F.col("r_name")))


@query(_GRAPH + "SELECT start_id, end_id, type FROM g WHERE start_id IN (SELECT id FROM n WHERE name < 'NATION_2') AND end_id IN (SELECT id FROM n WHERE name < 'NATION_2')")
def q_subgraph(spark, d):
    nodes, links = world(spark, d)
    return graph.induced(nodes, links, nodes.where("name < 'NATION_2'"))


@query(_GRAPH + "SELECT a.name AS start_name, b.name AS end_name FROM g JOIN n a ON start_id = a.id JOIN n b ON end_id = b.id")
def q_node_edge_node(spark, d):
    return graph.traverse(*world(spark, d), "IN_REGION").select("start_name", "end_name")


@query("WITH a AS (SELECT o_custkey AS k, count(*) AS v FROM orders GROUP BY 1), b AS (SELECT o_custkey AS k, count(*) AS v FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, a.v AS expected, b.v AS found FROM a FULL JOIN b ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def q_full_outer_reconcile(spark, d):
    count = lambda df: df.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("v"))
    orders = table(spark, d, "orders")
    return audit.reconcile(count(orders), count(orders.where("o_orderstatus <> 'P'")), "k", "v")


@query("SELECT DISTINCT 'order:' || substr(sha256(o_orderkey::VARCHAR), 1, 24) AS start_id, 'status:' || substr(sha256(o_orderstatus), 1, 24) AS end_id, 'HAS_STATUS' AS type FROM orders")
def q_build_edges(spark, d):
    return graph.edges_of(table(spark, d, "orders"), ("order", F.col("o_orderkey")), "HAS_STATUS", ("status", F.col("o_orderstatus")))


@query(_GRAPH + "SELECT count(*) AS n FROM g WHERE start_id IN (SELECT id FROM n WHERE name LIKE 'A%')")
def q_endpoint_matrix(spark, d):
    nodes, links = world(spark, d)
    relabelled = nodes.withColumn("label", F.when(F.col("name").startswith("A") & (F.col("label") == "nation"), "place").otherwise(F.col("label")))
    return graph.endpoint_violations(relabelled, links, [("IN_REGION", "nation", "region")]).agg(F.count("*").alias("n"))


@query("SELECT s_nationkey AS nation, count(DISTINCT s_name) AS n FROM supplier GROUP BY 1 HAVING count(DISTINCT s_name) > 1")
def q_conflicting_nodes(spark, d):
    nodes = table(spark, d, "supplier").select(F.col("s_nationkey").alias("id"), F.lit("nation").alias("label"), F.col("s_name").alias("name"))
    return graph.conflicting_nodes(nodes).select(F.col("id").alias("nation"), F.col("n_versions").alias("n"))


@query("SELECT o_orderkey AS id, 'order:' || substr(sha256(o_orderkey::VARCHAR), 1, 20) AS uid, o_orderpriority AS name FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 10")
def q_offset_limit(spark, d):
    rows = table(spark, d, "orders").orderBy("o_orderkey").offset(10).limit(25)
    return rows.select(F.col("o_orderkey").alias("id"), hashing.uid("order", F.col("o_orderkey").cast("string"), 20).alias("uid"), F.col("o_orderpriority").alias("name"))
