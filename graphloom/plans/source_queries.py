"""Sources and sinks: each query writes a table into the shared folder by one of them and returns what another reads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text, vectors
from ..operators import audit, constraints, timeline
from ..runtime import shared_folder
from ..sources import builds, readers
from ..streaming import windows
from .registry import query, table


def place(spark) -> str:
    return f"{shared_folder(spark).rstrip('/')}/source-{uuid.uuid4().hex}"


@query("SELECT doc_id, source, length(text) AS n FROM documents")
def q_json_lines(spark, d):
    path = place(spark)
    builds.export_lines(table(spark, d, "documents").select("doc_id", "source", "text"), path)
    return readers.json_lines(spark, path, "doc_id long, source string, text string").select("doc_id", "source", F.length("text").alias("n"))


@query("SELECT conv_id, turn, md5(text) AS sum FROM conversations")
def q_gzip_lines(spark, d):
    path = place(spark)
    builds.export_lines(table(spark, d, "conversations"), path, compressed=True)
    rows = readers.json_lines(spark, path, "conv_id long, turn long, role string, text string")
    return rows.select("conv_id", "turn", F.md5(F.col("text").cast("binary")).alias("sum"))


@query("SELECT event_id % 97 AS k, arg_max(event_id, event_id) AS v FROM events GROUP BY 1")
def q_checkpoint(spark, d):
    """The last record of each key of a checkpoint that was written in one run."""
    path = place(spark)
    table(spark, d, "events").select((F.col("event_id") % 97).alias("k"), F.col("event_id").alias("v")).repartition(1).sortWithinPartitions("v").write.json(path)
    return readers.checkpoint_lines(spark, path, "k", "k long, v long")


_GRAPH = "WITH n AS (SELECT 'n' || n_nationkey AS id, 'Nation' AS label, n_name AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, 'Region', r_name FROM region), e AS (SELECT 'e' || n_nationkey AS id, 'n' || n_nationkey AS start_id, 'r' || n_regionkey AS end_id, 'PART_OF' AS type, n_regionkey AS place FROM nation) "


def exported(spark, d) -> str:
    """The nations and regions as a graph's two CSV tables."""
    path = place(spark)
    node = lambda t, p, key, label, name: table(spark, d, t).select(F.concat(F.lit(p), key).alias("id"), F.lit(label).alias("label"), F.col(name).alias("name"))
    nodes = node("nation", "n", "n_nationkey", "Nation", "n_name").union(node("region", "r", "r_regionkey", "Region", "r_name"))
    edges = table(spark, d, "nation").select(F.concat(F.lit("e"), "n_nationkey").alias("id"), F.concat(F.lit("n"), "n_nationkey").alias("start_id"), F.concat(F.lit("r"), "n_regionkey").alias("end_id"), F.lit("PART_OF").alias("type"), F.col("n_regionkey").alias("place"))
    builds.export_graph(nodes, edges, path)
    return path


@query(_GRAPH + "SELECT id, label, name FROM n")
def q_graph_export(spark, d):
    back = readers.strict_csv(spark, f"{exported(spark, d)}/nodes", readers.NODE_CSV)
    return back.select("id", "label", F.from_json("properties_json", "name string").getField("name").alias("name"))


@query(_GRAPH + "SELECT 'label' AS what, label AS name, count(*) AS n FROM n GROUP BY 2 UNION ALL SELECT 'type', type, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'node_property', 'name', count(*) FROM n UNION ALL SELECT 'edge_property', 'place', count(*) FROM e")
def q_graph_described(spark, d):
    path = exported(spark, d)
    return readers.described(readers.strict_csv(spark, f"{path}/nodes", readers.NODE_CSV), readers.strict_csv(spark, f"{path}/relationships", readers.EDGE_CSV))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS balance FROM customer WHERE c_custkey % 5 <> 4 OR c_custkey % 3 = 0")
def q_upsert(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("balance"))
    incoming = rows.where("c_custkey % 3 = 0").withColumn("balance", F.col("balance") + 1)
    return builds.upserted(rows.where("c_custkey % 5 <> 4"), incoming.union(incoming), "c_custkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 4 = 0")
def q_append_only(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return builds.append_only(rows.where("o_orderkey % 4 <> 0"), rows.where("o_orderkey % 2 = 0"), "o_orderkey", "o_orderstatus")


@query("SELECT p_partkey FROM part WHERE p_size > 25")
def q_resume(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_size")
    return builds.todo(parts, parts.where("p_size <= 25"), "p_partkey").select("p_partkey")


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 2 = 0")
def q_active_build(spark, d):
    """The newest verified of two builds; a name that is taken is refused."""
    store = builds.Builds(spark, place(spark))
    store.publish("first", table(spark, d, "supplier"))
    store.publish("second", table(spark, d, "supplier").where("s_suppkey % 2 = 0"))
    return store.read().select("s_suppkey", "s_name", "s_acctbal")


@query("SELECT count(*) AS n_rows, 'verified' AS status FROM supplier")
def q_build_status(spark, d):
    store = builds.Builds(spark, place(spark))
    store.publish("one", table(spark, d, "supplier"))
    return store.status().where(F.col("build_id") == store.only()).select("n_rows", "status")


@query("SELECT count(*) AS n_documents, sum(n_chars)::BIGINT AS n_chars, 'texts' AS name FROM documents")
def q_report(spark, d):
    path = place(spark)
    builds.write_report(table(spark, d, "documents").agg(F.count("*").alias("n_documents"), F.sum("n_chars").alias("n_chars")).withColumn("name", F.lit("texts")), path)
    return spark.read.schema("n_documents long, n_chars long, name string").json(path)


@query("SELECT r_regionkey AS step, count(*) AS n FROM region, (SELECT unnest([1, 2])) GROUP BY 1")
def q_trace(spark, d):
    path = place(spark)
    for _ in range(2):
        builds.append_trace(table(spark, d, "region").select(F.col("r_regionkey").alias("step")), path)
    return spark.read.schema("step int, written_at timestamp").json(path).where("written_at IS NOT NULL").groupBy("step").agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE WHEN page_id % 4 = 0 OR page_id % 6 = 0 THEN 'made' ELSE 'cached' END AS origin FROM pages")
def q_inventory_cache(spark, d):
    """A quarter is new to the cache, and a sixth of it is of other contents."""
    found = table(spark, d, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("sha"))
    cached = found.where("page_id % 4 <> 0").select("page_id", F.when(F.col("page_id") % 6 == 0, "old").otherwise(F.col("sha")).alias("sha"), F.lit("cached").alias("origin"))
    made = builds.inventory(found, cached, "page_id", "sha", lambda rows: rows.withColumn("origin", F.lit("made")))
    return made.select("page_id", "origin")


@query("SELECT c_custkey::VARCHAR AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name ELSE c_mktsegment END AS title, NULL::VARCHAR AS note FROM customer")
def q_foreign_schema(spark, d):
    rows = table(spark, d, "customer").withColumn("name", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).otherwise(""))
    return readers.mapped(rows, {"id": ["key", "c_custkey"], "title": ["name", "c_name"], "note": ["remark"]})


@query("SELECT r_name || '/' || n_name AS folder FROM (SELECT DISTINCT r_name, n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0) ORDER BY 1 LIMIT 7")
def q_paired_folders(spark, d):
    """Folders with both files; every second nation lacks its goal."""
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    folder = F.concat("r_name", F.lit("/"), "n_name")
    files = F.array(F.when(F.col("n_nationkey") % 2 == 0, F.concat(folder, F.lit("/goal.txt"))), F.concat(folder, F.lit("/steps.txt")))
    members = nations.select(F.lit("a.zip").alias("archive"), F.explode(F.filter(files, lambda x: x.isNotNull())).alias("member"))
    return readers.paired_folders(members.withColumn("kind", readers.member_kind(F.col("member"))), 7).select("folder")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'image' WHEN 1 THEN 'video' WHEN 2 THEN 'steps' ELSE 'other' END AS kind FROM part")
def q_member_kind(spark, d):
    suffix = F.element_at(F.array(F.lit("/a.JPG"), F.lit("/b.mp4"), F.lit("/steps.txt"), F.lit("/x.bin")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", readers.member_kind(F.concat("p_name", suffix)).alias("kind"))


@query("WITH m AS (SELECT l_orderkey AS a, l_partkey * 100 AS s, l_partkey * 100 + 40 + l_linenumber * 20 AS e FROM lineitem), x AS (SELECT *, max(e) OVER (PARTITION BY a ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM m), y AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 300 THEN 1 ELSE 0 END) OVER (PARTITION BY a ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM x), z AS (SELECT *, floor((s - min(s) OVER (PARTITION BY a, island)) / 1000) AS part FROM y) SELECT a AS archive, min(s) AS first, max(e) AS last, count(*) AS n_members FROM z GROUP BY a, island, part")
def q_read_plan(spark, d):
    start = F.col("l_partkey") * 100
    members = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("archive"), start.alias("header_offset"), (start + 40 + F.col("l_linenumber") * 20).alias("entry_end"))
    return readers.read_plan(members, 300, 1000).select("archive", "first", "last", "n_members")


@query("SELECT 'n_dims' AS name, '0' AS expected, (SELECT min(len(embedding))::VARCHAR FROM embeddings) AS found UNION ALL SELECT 'n_rows', '-1', count(*)::VARCHAR FROM embeddings")
def q_manifest_check(spark, d):
    rows = table(spark, d, "embeddings")
    manifest = spark.createDataFrame([(-1, 0, 0)], "n_rows long, n_dims int, least long")
    return readers.manifest_differences(rows, manifest, {"n_rows": F.count("*"), "n_dims": F.min(F.size("embedding")), "least": F.min("vec_id")})


@query("SELECT doc_id, 'hash' AS reason FROM documents WHERE doc_id % 31 = 0 UNION ALL SELECT doc_id, 'repeated' FROM documents WHERE doc_id % 29 = 0")
def q_verified_corpus(spark, d):
    """A corpus with some hashes of other texts and some documents twice."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.sha2(F.when(F.col("doc_id") % 31 == 0, "other").otherwise(F.col("text")).cast("binary"), 256).alias("sha"))
    return readers.corpus_violations(docs.union(docs.where("doc_id % 29 = 0")), "doc_id", "text", "sha").distinct()


@query("SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 35")
def q_selection(spark, d):
    return readers.selection(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 35, 20)


@query("SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 5 = 0 THEN 'no_name' WHEN c_custkey % 7 = 0 THEN 'minutes' END AS reason FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 7 = 0")
def q_recipe_violations(spark, d):
    n = F.col("c_custkey")
    one = F.array(F.lit("stir"))
    source = F.struct(F.lit("s").alias("id"), F.lit("t").alias("title"), F.lit("u").alias("url"))
    rows = table(spark, d, "customer").select(n.cast("string").alias("id"), F.when(n % 5 != 0, F.col("c_name")).alias("name"), one.alias("ingredients"), one.alias("seasonings"), F.when((n % 7 == 0) & (n % 5 != 0), 0).alias("minutes"), one.alias("tags"), one.alias("steps"), source.alias("source"))
    return readers.recipe_violations(rows).withColumn("reason", F.when(F.col("reason") == "name", "no_name").otherwise(F.col("reason")))


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'repeated key' WHEN 2 THEN 'number NaN' WHEN 3 THEN 'malformed' ELSE 'no object' END AS fault FROM events")
def q_json_faults(spark, d):
    kinds = F.array(F.col("props"), F.lit('{"a": 1, "a": 2}'), F.lit('{"a": NaN}'), F.lit('{"a": '), F.lit("[1]"))
    return table(spark, d, "events").select("event_id", readers.json_fault(F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int"))).alias("fault"))


@query("SELECT doc_id, text AS decoded FROM documents")
def q_decoded(spark, d):
    """Bytes as UTF-8, half of them behind a byte order mark."""
    raw = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("﻿")).otherwise(""), "text").cast("binary")
    return table(spark, d, "documents").select("doc_id", readers.decoded(raw).alias("decoded"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'é' || n_name ELSE n_name END AS name FROM nation")
def q_repaired_names(spark, d):
    """Names whose UTF-8 bytes were read as code page 437: é comes as two other letters."""
    broken = "é".encode().decode("cp437")
    name = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(broken), "n_name")).otherwise(F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", readers.repaired_name(name).alias("name"))


@query("SELECT p_partkey, (CASE p_partkey % 4 WHEN 0 THEN 20 WHEN 1 THEN 30 WHEN 2 THEN 90 END)::DOUBLE AS minutes FROM part")
def q_minutes_limit(spark, d):
    asked = F.element_at(F.array(F.lit("in 20 minutes or 1 hour"), F.lit("within half an hour"), F.lit("1.5 小时以内"), F.lit("soon")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.minutes_limit(asked).alias("minutes"))


@query("SELECT p_partkey, [20003.0, 315.0, 0.5, 10000.0, 42.0][p_partkey % 5 + 1]::DOUBLE AS value FROM part")
def q_chinese_numbers(spark, d):
    said = F.element_at(F.array(*[F.lit(x) for x in ("二万零三", "三百一十五", "半", "一万", "42")]), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", text.chinese_number(said).alias("value"))


@query("SELECT p_partkey, replace(p_name, ' ', ' ') AS term FROM part")
def q_terms(spark, d):
    """Names behind punctuation and full-width letters come to the same terms."""
    wide = F.translate(F.upper("p_name"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ")
    return table(spark, d, "part").select("p_partkey", text.term(F.concat(F.lit("«"), F.regexp_replace(wide, " ", " - "), F.lit("»!"))).alias("term"))


@query("SELECT user_id, count(*) AS n FROM (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p >= t GROUP BY 1")
def q_not_increasing(spark, d):
    rows = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id")
    return timeline.not_increasing(rows, "user_id", "at", "event_id").groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_size BETWEEN 6 AND 1000 AND p_partkey % 3 <> 0 AS valid FROM part")
def q_box_valid(spark, d):
    box = F.array(F.lit(5.0), F.lit(0.0), F.col("p_size").cast("double"), F.when(F.col("p_partkey") % 3 == 0, -1.0).otherwise(10.0))
    return table(spark, d, "part").select("p_partkey", vectors.box_valid(box).alias("valid"))


@query("SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def q_late_tolerant(spark, d):
    """A stream with every event twice, de-duplicated under a watermark."""
    path = place(spark)
    rows = table(spark, d, "events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    rows.union(rows).write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    out = place(spark)
    windows.late_tolerant(stream, "ts", "400 days", "event_id").writeStream.format("parquet").option("path", out).option("checkpointLocation", place(spark)).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT l_orderkey AS owner FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1 HAVING count_if(p_name = 'cold widget') > 0 AND count_if(p_brand = 'Brand#13') > 0 AND count_if(p_name = 'red widget') = 0")
def q_graph_candidates(spark, d):
    from ..operators import retrieval

    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    edges = lines.select(F.col("l_orderkey").alias("owner"), F.explode(F.array("p_name", "p_brand")).alias("member"))
    return retrieval.graph_candidates(edges, "owner", "member", {"cold": ["cold widget"], "brand": ["Brand#13", "Brand#13"]}, ["red widget"])


@query("SELECT o_orderkey AS id FROM orders WHERE o_totalprice <= 60000 AND o_orderpriority = '1-URGENT'")
def q_tightened(spark, d):
    """Two demands together: the smaller bound and all tags."""
    both = constraints.Constraints(at_most=60000.0, allow_missing=True).tightened(constraints.Constraints(at_most=90000.0, required_tags=("1-URGENT",), allow_missing=True))
    empty = F.array().cast("array<string>")
    test = constraints.eligible(both, members=empty, extras=empty, value=F.col("o_totalprice"), tags=F.array("o_orderpriority"), name=F.col("o_orderstatus"))
    return table(spark, d, "orders").where(test).select(F.col("o_orderkey").alias("id"))


@query("SELECT n_name AS id, n_nationkey - 3 AS position FROM nation WHERE n_nationkey BETWEEN 3 AND 9")
def q_listed_order(spark, d):
    from ..operators import evidence

    rows = table(spark, d, "nation").select(F.col("n_name").alias("id"))
    return evidence.in_listed_order(rows, "id", [f"NATION_{i}" for i in range(3, 10)])


@query("SELECT vec_id, 'norm' AS reason FROM embeddings WHERE vec_id % 71 = 0 UNION ALL SELECT vec_id, 'size' FROM embeddings WHERE vec_id % 67 = 0 AND vec_id % 71 <> 0")
def q_vector_audit(spark, d):
    """Vectors that were spoilt: some scaled, some cut short."""
    n = F.col("vec_id")
    size = len(table(spark, d, "embeddings").first().embedding)
    v = F.when(n % 71 == 0, F.transform("embedding", lambda x: x * 3)).when(n % 67 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    rows = table(spark, d, "embeddings").select("vec_id", F.transform(v, lambda x: x.cast("double")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    own = F.sqrt(F.lit(4.0))
    return audit.violations(rows, "vec_id", {"size": F.size("v") == size, "norm": (F.size("v") != size) | (norm < own)})


@query("SELECT n_nationkey, CASE WHEN n_nationkey < 20 THEN 'plain' ELSE 'packed' END AS origin FROM nation")
def q_plain_over_packed(spark, d):
    """A folder with files in both forms; where both are there, the plain one counts."""
    path = place(spark)
    rows = table(spark, d, "nation").select("n_nationkey")
    for name, part, origin, packed in (("a", "n_nationkey < 20", "plain", False), ("a", "n_nationkey < 20", "packed", True), ("b", "n_nationkey >= 20", "packed", True)):
        out = place(spark)
        rows.where(part).withColumn("origin", F.lit(origin)).coalesce(1).write.option("compression", "gzip" if packed else "none").json(out)
        readers.move_single(spark, out, f"{path}/{name}.json{'.gz' if packed else ''}")
    return readers.newest_form(spark, path, "n_nationkey int, origin string")
