"""An audit of a whole graph against what it was made of: every rule's violations in one table.

Rules are columns in three tables. Whatever names a node (ends of edges, evidence, associations, steps with their
recipe) meets the nodes in one join, whatever names a place (a member of an archive, or a line of one) meets the
places in another, and counts by medium and by pair come from one aggregation each. Every given table is read once;
nodes are parsed once and written into the shared folder with the source each of them names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as texts_
from ..runtime import saved

PROPERTIES = (
    "split string, dataset_revision string, archive string, member string, sha256 string, source_type string, recipe_id string, order long, text string, source_id string, "
    "origin_archive string, recipe_directory string, title string, steps_count long, text_complete boolean, size_bytes long, compressed_size_bytes long, crc32 long"
)
#: Labels and types of the graph, the kind of source that holds text, how an association was found.
MEDIA, LINKS = {"Image": "image", "Video": "video"}, {"image": "HAS_IMAGE", "video": "HAS_VIDEO"}
TEXT_SOURCE, SAME_FOLDER, UNMATCHED = "huggingface_zip_text", "same_exact_archive_directory", "unmatched_or_ambiguous_directory"
RULES = (
    "node_id", "node_repeated", "node_scope", "node_archive", "step_order", "step_source", "step_recipe_source", "media_source", "media_link",
    "edge_repeated", "edge_scope", "edge_end", "edge_step_recipe",
    "evidence_step", "evidence_span", "evidence_text", "evidence_name", "evidence_source", "evidence_origin", "evidence_recipe", "evidence_scope",
    "recipe_dropped", "recipe_changed", "recipe_incomplete_lost", "recipe_repeated",
    "association_media", "association_origin", "association_archive", "association_recipe", "association_folder", "association_link", "association_reason", "association_known", "association_linked",
    "text_repeated", "text_hash", "text_archive", "text_covered", "member_repeated", "member_archive", "source_member", "source_text", "source_hash",
    "line_missing", "line_changed", "line_covered", "media_member", "media_covered", "orphan_dropped", "orphan_link",
)


@dataclass(frozen=True)
class Originals:
    """members(archive, member, kind, size, compressed_size, crc32), texts(archive, member, sha256, text),
    recipes(id, archive, folder, title, steps_member, n_steps), media(archive, member, recipe_id): recorded associations."""

    members: DataFrame
    texts: DataFrame
    recipes: DataFrame
    media: DataFrame


@dataclass(frozen=True)
class Graph:
    """nodes(id, label, properties_json), edges(id, type, start_id, end_id, properties_json),
    evidence(id, step_id, recipe_id, step_order, name, span_start, span_end, text, source_id, archive, member, revision),
    associations(media_id, recipe_id, archive, member, method)."""

    nodes: DataFrame
    edges: DataFrame
    evidence: DataFrame
    associations: DataFrame


def _broken(rules: dict[str, Column]) -> Column:
    """The names of the rules that do not hold; a rule that is null does not."""
    return F.filter(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())


def _only(condition: Column, test: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False)) | F.coalesce(test, F.lit(False))


def _reasons(df: DataFrame, id_: str = "id", reasons: str = "reasons") -> DataFrame:
    return df.select(F.explode(reasons).alias("rule"), F.col(id_).cast("string").alias("id"))


def _nodes(nodes: DataFrame, scope: Column, allowed: Column) -> DataFrame:
    """(id, n, label, p, origin): a row an id, of repeated ones the smallest record, with the source it names."""
    rows = nodes.select("id", "label", F.from_json("properties_json", PROPERTIES).alias("p"))
    rows = rows.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("label", "p")).alias("r")).select("id", "n", "r.*")
    rows = saved(rows)
    sources = rows.where("label = 'Source'").select(F.col("id").alias("__source"), F.struct(F.col("p.archive").alias("archive"), F.col("p.member").alias("member"), F.col("p.dataset_revision").alias("revision")).alias("origin"))
    p, label = F.col("p"), F.col("label")
    rules = {
        "node_id": F.trim(F.coalesce("id", F.lit(""))) != "",
        "node_repeated": F.col("id").isNull() | (F.col("n") == 1),
        "node_scope": (p["split"] == scope["split"]) & (p["dataset_revision"] == scope["revision"]),
        "node_archive": _only(label.isin("Source", *MEDIA), F.array_contains(allowed, p["archive"])) & _only(label == "Recipe", F.array_contains(allowed, p["origin_archive"])),
        "step_order": _only(label == "Step", p["order"].isNotNull()),
        "step_source": _only(label == "Step", F.col("origin").isNotNull()),
        "media_source": _only(label.isin(*MEDIA), (F.col("origin.archive") == p["archive"]) & (F.col("origin.member") == p["member"])),
    }
    return saved(rows.join(sources, F.col("p.source_id") == F.col("__source"), "left").drop("__source").withColumn("reasons", _broken(rules)))


def _known(nodes: DataFrame, recipes: DataFrame) -> DataFrame:
    """(id, node, record): the nodes and the recorded recipes by id; null ids stand alone."""
    record = recipes.groupBy("id").agg(F.count("*").alias("n"), F.min(F.struct("archive", "folder", "title", "n_steps", "steps_member")).alias("r")).select(F.col("id").alias("__id"), F.struct("n", "r.*").alias("record"))
    both = nodes.select("id", F.struct("label", "p", "origin").alias("node")).join(record, F.col("id") == F.col("__id"), "full")
    return both.select(F.coalesce("id", "__id").alias("id"), "node", "record")


def _records(known: DataFrame) -> DataFrame:
    node, r, p = F.col("node"), F.col("record"), F.col("node.p")
    same = p["origin_archive"].eqNullSafe(r["archive"]) & p["recipe_directory"].eqNullSafe(r["folder"]) & p["title"].eqNullSafe(r["title"]) & p["steps_count"].eqNullSafe(r["n_steps"])
    rules = {
        "recipe_dropped": node["label"] == "Recipe",
        "recipe_changed": same,
        "recipe_incomplete_lost": r["steps_member"].isNotNull() | ((p["steps_count"] == 0) & ~F.coalesce(p["text_complete"], F.lit(False))),
        "recipe_repeated": r["n"] == 1,
    }
    return _reasons(known.where(r.isNotNull()).withColumn("reasons", _broken(rules)))


_CARRIED = {"recipe_id": "string", "step_order": "long", "name": "string", "span_start": "long", "span_end": "long", "text": "string", "source_id": "string", "archive": "string", "member": "string", "revision": "string"}


def _carried(**values: Column) -> Column:
    """What a row that names a node brings to the rules."""
    return F.struct(*[values.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in _CARRIED.items()])


def _end(role: str, key: str, other: str) -> Column:
    return F.struct(F.lit(role).alias("role"), F.col(key).cast("string").alias("key"), F.col(other).cast("string").alias("other"))


def _named(graph: Graph, nodes: DataFrame, known: DataFrame, scope: Column, allowed: Column) -> DataFrame:
    """(role, id, key, other, kind, label, own, archive, member, reasons): all that names a node, joined with it once."""

    def rows(df: DataFrame, role: Column, id_: Column, key: Column, carried: Column, other: Column = F.lit(None), kind: Column = F.lit(None), fine: Column = F.lit(True)) -> DataFrame:
        strings = {"id": id_, "key": key, "other": other, "kind": kind}
        return df.select(role.alias("role"), *[c.cast("string").alias(n) for n, c in strings.items()], fine.alias("fine"), carried.alias("e"))

    p = F.from_json("properties_json", "split string, dataset_revision string")
    ends = graph.edges.select("id", "type", F.coalesce((p["split"] == scope["split"]) & (p["dataset_revision"] == scope["revision"]), F.lit(False)).alias("fine"), F.explode(F.array(_end("start", "start_id", "end_id"), _end("end", "end_id", "start_id"))).alias("s"))
    both = F.array(_end("media", "media_id", "recipe_id"), _end("owner", "recipe_id", "media_id"))
    pairs = graph.associations.select("*", F.explode(F.filter(both, lambda x: (x["role"] == "media") | x["key"].isNotNull())).alias("s"))
    place = _carried(archive=F.col("archive"), member=F.col("member"))
    all_ = (
        rows(ends, F.col("s.role"), F.col("id"), F.col("s.key"), _carried(), F.col("s.other"), F.col("type"), F.col("fine"))
        .union(rows(graph.evidence, F.lit("evidence"), F.col("id"), F.col("step_id"), _carried(**{c: F.col(c) for c in _CARRIED})))
        .union(rows(pairs, F.col("s.role"), F.concat_ws("|", "recipe_id", "media_id"), F.col("s.key"), place, F.col("s.other"), F.col("method")))
        .union(rows(nodes.where("label = 'Step'"), F.lit("step"), F.col("id"), F.col("p.recipe_id"), _carried(archive=F.col("origin.archive"), member=F.col("origin.member"))))
    )
    found = all_.join(known.withColumnRenamed("id", "__id"), F.col("key") == F.col("__id"), "left")
    role, e, node, q, origin, record = F.col("role"), F.col("e"), F.col("node"), F.col("node.p"), F.col("node.origin"), F.col("record")
    edge, start, end = role.isin("start", "end"), e["span_start"], e["span_end"]
    is_step, is_media = node["label"] == "Step", node["label"].isin(*MEDIA)
    span = (start >= 0) & (start < end) & (end <= F.length(q["text"]))
    step_there = (role == "evidence") & F.coalesce(is_step, F.lit(False))
    associated = (role == "media") & F.coalesce(is_media, F.lit(False))
    folder = F.regexp_extract(e["member"], r"^(.*)/[^/]*$", 1)
    rules = {
        "edge_scope": _only(role == "start", F.col("fine")),
        "edge_end": _only(edge, node.isNotNull()),
        "edge_step_recipe": _only((role == "end") & (F.col("kind") == "HAS_STEP"), is_step & (q["recipe_id"] == F.col("other"))),
        "evidence_step": _only(role == "evidence", is_step),
        "evidence_span": _only(step_there, span),
        "evidence_text": _only(step_there, e["text"].eqNullSafe(q["text"])),
        "evidence_name": _only(step_there, span & (F.substring(q["text"], start.cast("int") + 1, (end - start).cast("int")) == e["name"])),
        "evidence_source": _only(step_there, e["source_id"].eqNullSafe(q["source_id"])),
        "evidence_origin": _only(step_there, e["archive"].eqNullSafe(origin["archive"]) & e["member"].eqNullSafe(origin["member"]) & e["revision"].eqNullSafe(origin["revision"])),
        "evidence_recipe": _only(step_there, e["recipe_id"].eqNullSafe(q["recipe_id"]) & e["step_order"].eqNullSafe(q["order"])),
        "evidence_scope": _only(step_there, F.array_contains(allowed, e["archive"]) & (e["revision"] == scope["revision"])),
        "step_recipe_source": _only(role == "step", (e["archive"] == record["archive"]) & (e["member"] == record["steps_member"])),
        "association_media": _only(role == "media", is_media),
        "association_origin": _only(associated, e["archive"].eqNullSafe(q["archive"]) & e["member"].eqNullSafe(q["member"])),
        "association_archive": _only(associated, F.array_contains(allowed, q["archive"])),
        "association_reason": _only(associated & F.col("other").isNull(), F.col("kind") == UNMATCHED),
        "association_recipe": _only(role == "owner", node["label"] == "Recipe"),
        "association_folder": _only((role == "owner") & (F.col("kind") == SAME_FOLDER) & (node["label"] == "Recipe"), (q["origin_archive"] == e["archive"]) & (q["recipe_directory"] == F.when(folder == "", ".").otherwise(folder))),
    }
    own = F.coalesce((role == "start") & (F.col("kind") == "HAS_SOURCE") & (F.col("other") == q["source_id"]), F.lit(False))
    return saved(found.select("role", "id", "key", "other", "kind", node["label"].alias("label"), own.alias("own"), q["archive"].alias("archive"), q["member"].alias("member"), _broken(rules).alias("reasons")))


_PLACE = ["archive", "member", "line"]


def _places(originals: Originals, nodes: DataFrame) -> DataFrame:
    """(archive, member, line, ...): what lies at each place and how many nodes are of it; line 0 is the whole member."""
    values = {"what": "string", "m": "struct<kind: string, size: long, compressed_size: long, crc32: long>", "sha256": "string", "fine": "boolean", "text": "string"}

    def at(df: DataFrame, what: Column, line: Column = F.lit(0), **given: Column) -> DataFrame:
        columns = {"what": what, **given}
        return df.select("archive", "member", line.cast("long").alias("line"), *[columns.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in values.items()])

    hashes = [F.sha2(F.col("text").cast("binary"), 256), F.sha2(F.concat(F.lit("\ufeff"), "text").cast("binary"), 256)]  # with and without a mark of byte order
    steps = F.when(F.element_at(F.split("member", "/"), -1) == "steps.txt", texts_.lines(F.col("text")))
    entry = lambda line, text: F.struct(line.cast("long").alias("line"), text.cast("string").alias("text"))
    lines = F.transform(F.coalesce(steps, F.array().cast("array<string>")), lambda x, i: entry(i + 1, x))
    read = originals.texts.select("archive", "member", "sha256", F.col("sha256").isin(*hashes).alias("fine"), F.explode(F.concat(F.array(entry(F.lit(0), F.lit(None))), lines)).alias("s"))
    whole = F.col("s.line") == 0
    texts = at(read, F.when(whole, "text").otherwise("line"), F.col("s.line"), sha256=F.when(whole, F.col("sha256")), fine=F.coalesce("fine", F.lit(False)), text=F.col("s.text"))
    members = at(originals.members, F.lit("member"), m=F.struct("kind", "size", "compressed_size", "crc32"))
    step = F.col("label") == "Step"
    used = nodes.where(F.col("label").isin("Step", *MEDIA) | ((F.col("label") == "Source") & (F.col("p.source_type") == TEXT_SOURCE)))
    used = used.select(F.when(step, F.col("origin.archive")).otherwise(F.col("p.archive")).alias("archive"), F.when(step, F.col("origin.member")).otherwise(F.col("p.member")).alias("member"), F.when(step, F.col("p.order")).otherwise(0).alias("n"), F.col("label").alias("w"))
    rows = reduce(DataFrame.union, [members, texts, at(originals.media.where("recipe_id IS NOT NULL"), F.lit("recipe")), at(used, F.col("w"), F.col("n"))])
    n = lambda *what: F.count_if(F.col("what").isin(*what))
    counts = {"n_members": n("member"), "n_texts": n("text"), "n_lines": n("line"), "n_recipes": n("recipe"), "n_sources": n("Source"), "n_media": n(*MEDIA), "n_images": n("Image"), "n_steps": n("Step")}
    return saved(rows.groupBy(*_PLACE).agg(*[c.alias(name) for name, c in counts.items()], F.min("m").alias("m"), F.min("sha256").alias("sha256"), F.min("text").alias("line_text"), F.coalesce(F.bool_and(F.when(F.col("what") == "text", F.col("fine"))), F.lit(True)).alias("fine")))


def _place_findings(places: DataFrame, allowed: Column) -> DataFrame:
    c = F.col
    image, medium = c("m.kind") == "image", c("m.kind").isin(*LINKS)
    rules = {
        "member_repeated": c("n_members") < 2,
        "member_archive": (c("n_members") == 0) | F.array_contains(allowed, c("archive")),
        "text_repeated": c("n_texts") < 2,
        "text_archive": (c("n_texts") == 0) | F.array_contains(allowed, c("archive")),
        "text_hash": c("fine"),
        "text_covered": (c("n_texts") == 0) | (c("n_sources") == 1),
        "line_covered": (c("n_lines") == 0) | ((c("n_lines") == 1) & (c("n_steps") == 1)),
        "media_covered": _only(medium, c("n_media") == 1),
        "orphan_dropped": _only(image & (c("n_recipes") == 0), c("n_images") > 0),
    }
    name = F.concat_ws("|", "archive", "member", F.when(c("line") > 0, c("line")))
    return _reasons(places.select(name.alias("id"), _broken(rules).alias("reasons")))


def _claims(nodes: DataFrame, named: DataFrame, places: DataFrame) -> DataFrame:
    """What sources, steps, media and unmatched associations say of their places, and the edges of media."""
    p, step = F.col("p"), F.col("label") == "Step"
    from_nodes = nodes.where(F.col("label").isin("Source", "Step", *MEDIA)).select(
        "id", F.col("id").alias("node"), "label", F.when(step, F.col("origin.archive")).otherwise(p["archive"]).alias("archive"), F.when(step, F.col("origin.member")).otherwise(p["member"]).alias("member"),
        F.when(step, p["order"]).otherwise(0).cast("long").alias("line"), p["text"].alias("text"), p["sha256"].alias("sha"), p["source_type"].alias("source_type"), F.struct(p["size_bytes"], p["compressed_size_bytes"], p["crc32"]).alias("size"),
    )
    loose = named.where((F.col("role") == "media") & F.col("label").isin(*MEDIA) & F.col("other").isNull())
    empty = lambda name: F.lit(None).cast(from_nodes.schema[name].dataType).alias(name)
    unmatched = loose.select("id", F.col("key").alias("node"), F.lit("unmatched").alias("label"), "archive", "member", F.lit(0).cast("long").alias("line"), *[empty(n) for n in ("text", "sha", "source_type", "size")])
    links = named.where(F.col("label").isin(*MEDIA) & F.col("role").isin("start", "end")).groupBy(F.col("key").alias("node")).agg(F.count_if("own").alias("n_own"), F.count_if((F.col("role") == "end") & F.col("kind").isin(*LINKS.values())).alias("n_linked"))
    rows = from_nodes.union(unmatched).join(places, _PLACE, "left").join(links, "node", "left").fillna(0, ["n_own", "n_linked", "n_members", "n_texts", "n_recipes"])
    label, m, size = F.col("label"), F.col("m"), F.col("size")
    source, medium = label == "Source", label.isin(*MEDIA)
    text_source = source & (F.col("source_type") == TEXT_SOURCE)
    kind = F.when(label == "Image", "image").otherwise("video")
    orphan = (label == "Image") & (m["kind"] == "image") & (F.col("n_recipes") == 0)
    linked = F.when(label == "unmatched", F.col("n_linked") == 0)
    rules = {
        "source_member": _only(source, F.col("n_members") > 0),
        "source_text": _only(text_source, F.col("n_texts") > 0),
        "source_hash": _only(text_source & (F.col("n_texts") > 0), F.col("sha").eqNullSafe(F.col("sha256"))),
        "line_missing": _only(step, F.col("line_text").isNotNull()),
        "line_changed": _only(step & F.col("line_text").isNotNull(), F.col("text") == F.col("line_text")),
        "media_member": _only(medium, (m["kind"] == kind) & m["size"].eqNullSafe(size["size_bytes"]) & m["compressed_size"].eqNullSafe(size["compressed_size_bytes"]) & m["crc32"].eqNullSafe(size["crc32"])),
        "media_link": _only(medium, F.col("n_own") > 0),
        "orphan_link": _only(orphan, (F.col("n_own") > 0) & (F.col("n_linked") == 0)),
        "association_known": _only(label == "unmatched", F.col("n_recipes") == 0),
        "association_linked": _only(label == "unmatched", linked),
    }
    return _reasons(rows.select("id", _broken(rules).alias("reasons")))


def _pairs(named: DataFrame) -> DataFrame:
    """Associations of a recipe and a medium that no edge of the right type joins; one row a pair."""
    medium = F.col("label").isin(*MEDIA) & F.col("other").isNotNull()
    edges = named.where((F.col("role") == "end") & F.col("kind").isin(*LINKS.values()) & medium)
    wanted = F.when(F.col("label") == "Image", LINKS["image"]).otherwise(LINKS["video"])
    asked = named.where((F.col("role") == "media") & medium).select("other", "key", wanted.alias("kind"), F.lit(1).alias("a"))
    both = asked.union(edges.select("other", "key", "kind", F.lit(0))).groupBy("other", "key", "kind").agg(F.max("a").alias("a"), F.min("a").alias("e"))
    return both.where("a = 1 AND e = 1").select(F.lit("association_link").alias("rule"), F.concat_ws("|", "other", "key").alias("id"))


def audited(originals: Originals, graph: Graph, revision: str, archives: Sequence[str], split: str = "test") -> DataFrame:
    """(rule, id): a row for each of RULES that a node, edge, line of evidence, association, record or place breaks.

    Places are 'archive|member' or 'archive|member|line', associations 'recipe|media'. Lines of texts are the stripped
    ones that are not blank, numbered from 1; only members named steps.txt have them. Of nodes or recipes with one id the
    smallest is audited and the id reported as repeated, of members or texts of one place likewise. A null, or
    properties that are no JSON object, break each rule that needs a value. Rules about what is not there (a step's line, an
    evidence's step) are broken alone: nothing else is said of it. Empty tables break nothing; other columns are ignored.
    Ids that are null are reported as null.
    """
    scope, allowed = F.struct(F.lit(split).alias("split"), F.lit(revision).alias("revision")), F.array(*[F.lit(a) for a in archives]).cast("array<string>")
    nodes = _nodes(graph.nodes, scope, allowed)
    known = _known(nodes, originals.recipes)
    named, places = _named(graph, nodes, known, scope, allowed), _places(originals, nodes)
    repeated = named.where("role = 'start'").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("edge_repeated").alias("rule"), "id")
    return reduce(DataFrame.union, [_reasons(nodes), _records(known), _reasons(named), _place_findings(places, allowed), _claims(nodes, named, places), _pairs(named), repeated])


def report(findings: DataFrame) -> DataFrame:
    """(rule, n_broken, passed): a row for each rule, also for those that nothing breaks."""
    rules = findings.sparkSession.range(1).select(F.explode(F.array(*[F.lit(r) for r in RULES])).alias("rule"))
    counts = findings.groupBy("rule").agg(F.count("*").alias("n_broken"))
    return rules.join(counts, "rule", "left").select("rule", F.coalesce("n_broken", F.lit(0)).alias("n_broken"), F.col("n_broken").isNull().alias("passed"))
