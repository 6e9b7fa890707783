"""The audit of a whole graph: documents as recipes with steps, pages as images, spoilt in known places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import artifacts
from .registry import query, table

_REVISION, _ARCHIVES = "v1", ("a0", "a1", "a2")


def _json(**properties):
    return F.to_json(F.struct(F.lit("test").alias("split"), F.lit(_REVISION).alias("dataset_revision"), *[c.alias(n) for n, c in properties.items()]))


def _union(first, *more):
    for df in more:
        first = first.union(df)
    return first


def spoilt(spark, d):
    """(originals, graph) of the given tables; every fault is a remainder of an id."""
    c, lit, text_id = F.col, F.lit, lambda prefix, column: F.concat(lit(prefix), column)
    docs = table(spark, d, "documents").select(c("doc_id").alias("d"), F.concat(lit("a"), c("doc_id") % 3).alias("archive"), F.coalesce("text", lit("")).alias("text"))
    docs = docs.withColumns({"whole": c("d") % 19 != 0, "member": F.concat("d", lit("/steps.txt"))})
    n_steps = F.when(c("whole"), F.size(text.lines(c("text")))).otherwise(0).cast("long")
    texts = docs.where("whole").select("d", "archive", "member", F.sha2(c("text").cast("binary"), 256).alias("sha256"), "text")
    recipes = docs.select(text_id("r", c("d")).alias("id"), "archive", c("d").cast("string").alias("folder"), text_id("t", c("d")).alias("title"), F.when(c("whole"), c("member")).alias("steps_member"), n_steps.alias("n_steps"))
    lines = texts.select("d", F.posexplode(text.lines(c("text"))).alias("i", "line")).withColumn("i", c("i") + 1)
    ids = table(spark, d, "documents").select(c("doc_id").alias("d"), lit(True).alias("of_recipe")).distinct()
    pages = table(spark, d, "pages").select(c("page_id").alias("p"), F.length("html").cast("long").alias("size")).join(ids, c("p") == c("d"), "left")
    pages = pages.select("p", "size", F.concat(lit("a"), c("p") % 3).alias("archive"), F.concat(lit("pics/"), c("p"), lit(".jpg")).alias("member"), (F.coalesce("of_recipe", lit(False)) & (c("p") % 2 == 0)).alias("paired"))
    recipe_of, image = F.when(c("paired"), text_id("r", c("p"))), text_id("m", c("p"))
    zero = lit(0).cast("long")
    members = texts.select("archive", "member", lit("steps").alias("kind"), F.length("text").cast("long").alias("size"), zero.alias("compressed_size"), zero.alias("crc32")).union(pages.select("archive", "member", lit("image"), "size", "size", "p"))
    originals = artifacts.Originals(members, texts, recipes, pages.select("archive", "member", recipe_of.alias("recipe_id")))

    node = lambda df, id_, label, **p: df.select(id_.alias("id"), lit(label).alias("label"), _json(**p).alias("properties_json"))
    line_id = F.concat(lit("st"), c("d"), lit("-"), c("i"))
    nodes = _union(
        node(docs.where("d % 29 <> 0"), text_id("r", c("d")), "Recipe", origin_archive=c("archive"), recipe_directory=c("d").cast("string"), title=F.when(c("d") % 23 == 0, "x").otherwise(text_id("t", c("d"))), steps_count=n_steps, text_complete=c("whole")),
        node(texts, text_id("s", c("d")), "Source", archive=c("archive"), member=c("member"), sha256=F.when(c("d") % 31 == 0, "0").otherwise(c("sha256")), source_type=lit(artifacts.TEXT_SOURCE)),
        node(lines.where("NOT (d % 41 = 0 AND i = 1)"), line_id, "Step", recipe_id=text_id("r", c("d")), order=c("i"), text=F.when((c("d") % 37 == 0) & (c("i") == 1), F.concat("line", lit("!"))).otherwise(c("line")), source_id=text_id("s", c("d"))),
        node(pages, text_id("ms", c("p")), "Source", archive=c("archive"), member=c("member"), source_type=lit("image")),
        node(pages.where("p % 13 <> 0"), image, "Image", archive=c("archive"), member=c("member"), source_id=text_id("ms", c("p")), size_bytes=F.when(c("p") % 7 == 0, c("size") + 1).otherwise(c("size")), compressed_size_bytes=c("size"), crc32=c("p")),
    )
    edge = lambda df, kind, start, end: df.select(F.concat_ws(":", lit(kind), start, end).alias("id"), lit(kind).alias("type"), start.alias("start_id"), end.alias("end_id"), _json().alias("properties_json"))
    edges = _union(edge(lines, "HAS_STEP", text_id("r", c("d")), line_id), edge(pages.where("p % 11 <> 0"), "HAS_SOURCE", image, text_id("ms", c("p"))), edge(pages.where("paired AND p % 10 <> 0"), "HAS_IMAGE", recipe_of, image))
    name = F.substring("line", 1, 3)
    evidence = lines.where("i = 1").select(text_id("v", c("d")).alias("id"), line_id.alias("step_id"), text_id("r", c("d")).alias("recipe_id"), c("i").alias("step_order"), F.when(c("d") % 43 == 0, F.concat(name, lit("?"))).otherwise(name).alias("name"), lit(0).alias("span_start"), F.length(name).alias("span_end"), c("line").alias("text"), text_id("s", c("d")).alias("source_id"), F.concat(lit("a"), c("d") % 3).alias("archive"), F.concat("d", lit("/steps.txt")).alias("member"), lit(_REVISION).alias("revision"))
    method = F.when(c("paired"), "other_method").when(c("p") % 9 != 0, artifacts.UNMATCHED)
    associations = pages.select(image.alias("media_id"), recipe_of.alias("recipe_id"), "archive", "member", method.alias("method"))
    return originals, artifacts.Graph(nodes, edges, evidence, associations)


_FOUND = """WITH docs AS (SELECT doc_id AS d, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents),
ls AS (SELECT d, unnest(range(1, len(l) + 1)) AS i FROM docs WHERE d % 19 <> 0), st AS (SELECT d, i, d % 41 = 0 AND i = 1 AS gone FROM ls),
ps AS (SELECT page_id AS p, 'm' || page_id AS m, page_id % 13 = 0 AS gone, page_id % 2 = 0 AND page_id IN (SELECT doc_id FROM documents) AS paired FROM pages),
found AS (
SELECT 'recipe_dropped' AS rule, 'r' || d AS id FROM docs WHERE d % 29 = 0
UNION ALL SELECT 'recipe_changed', 'r' || d FROM docs WHERE d % 29 = 0 OR d % 23 = 0
UNION ALL SELECT 'recipe_incomplete_lost', 'r' || d FROM docs WHERE d % 29 = 0 AND d % 19 = 0
UNION ALL SELECT 'source_hash', 's' || d FROM docs WHERE d % 31 = 0 AND d % 19 <> 0
UNION ALL SELECT 'line_changed', 'st' || d || '-1' FROM st WHERE i = 1 AND d % 37 = 0 AND NOT gone
UNION ALL SELECT 'line_covered', 'a' || d % 3 || '|' || d || '/steps.txt|1' FROM st WHERE gone
UNION ALL SELECT 'edge_end', 'HAS_STEP:r' || d || ':st' || d || '-' || i FROM st, (VALUES (1), (2)) AS t(k) WHERE CASE k WHEN 1 THEN d % 29 = 0 ELSE gone END
UNION ALL SELECT 'edge_step_recipe', 'HAS_STEP:r' || d || ':st' || d || '-' || i FROM st WHERE gone
UNION ALL SELECT 'evidence_step', 'v' || d FROM st WHERE gone
UNION ALL SELECT 'evidence_text', 'v' || d FROM st WHERE i = 1 AND d % 37 = 0 AND NOT gone
UNION ALL SELECT 'evidence_name', 'v' || d FROM st WHERE i = 1 AND d % 43 = 0 AND NOT gone
UNION ALL SELECT 'media_covered', 'a' || p % 3 || '|pics/' || p || '.jpg' FROM ps WHERE gone
UNION ALL SELECT 'orphan_dropped', 'a' || p % 3 || '|pics/' || p || '.jpg' FROM ps WHERE gone AND NOT paired
UNION ALL SELECT 'association_media', CASE WHEN paired THEN 'r' || p || '|' ELSE '' END || m FROM ps WHERE gone
UNION ALL SELECT 'association_recipe', 'r' || p || '|' || m FROM ps WHERE paired AND p % 29 = 0
UNION ALL SELECT 'association_link', 'r' || p || '|' || m FROM ps WHERE paired AND p % 10 = 0 AND NOT gone
UNION ALL SELECT 'association_reason', m FROM ps WHERE NOT paired AND p % 9 = 0 AND NOT gone
UNION ALL SELECT 'edge_end', 'HAS_SOURCE:' || m || ':ms' || p FROM ps WHERE gone AND p % 11 <> 0
UNION ALL SELECT 'edge_end', 'HAS_IMAGE:r' || p || ':' || m FROM ps, (VALUES (1), (2)) AS t(k) WHERE paired AND p % 10 <> 0 AND CASE k WHEN 1 THEN gone ELSE p % 29 = 0 END
UNION ALL SELECT 'media_member', m FROM ps WHERE p % 7 = 0 AND NOT gone
UNION ALL SELECT 'media_link', m FROM ps WHERE p % 11 = 0 AND NOT gone
UNION ALL SELECT 'orphan_link', m FROM ps WHERE NOT paired AND p % 11 = 0 AND NOT gone) """


@query(_FOUND + "SELECT rule, id FROM found")
def q_artifact_audit(spark, d):
    """Every violation of every rule, by rule and id."""
    return artifacts.audited(*spoilt(spark, d), _REVISION, _ARCHIVES)


@query(_FOUND + f"SELECT r.rule, count(id) AS n_broken, count(id) = 0 AS passed FROM (SELECT unnest({list(artifacts.RULES)}) AS rule) AS r LEFT JOIN found USING (rule) GROUP BY 1")
def q_artifact_report(spark, d):
    """All rules with how often each is broken, those that hold included."""
    return artifacts.report(artifacts.audited(*spoilt(spark, d), _REVISION, _ARCHIVES))
