"""Bundles: a layer of new nodes and relationships over an existing graph, built from artifacts and validated as a whole.

nodes(id, label, owner, reference): references name nodes of the base graph, all others are new. relationships
(id, start_id, end_id, type, owner). The owner is the medium that a statement comes from.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import saved

#: Tables of so many rows go out to all tasks.
FEW = 1 << 18


def adjacent_pairs(rows: DataFrame, key: str, at: str, id_col: str) -> DataFrame:
    """(key, before, after): every row with every row of the next later time of its key; rows of one time are not paired."""
    times = rows.select(key, at).distinct().withColumn("__k", F.row_number().over(Window.partitionBy(key).orderBy(at)))
    placed = rows.select(key, at, id_col).join(times, [key, at]).select(key, id_col, "__k")
    later = placed.select(key, F.col(id_col).alias("after"), (F.col("__k") - 1).alias("__k"))
    return placed.withColumnRenamed(id_col, "before").join(later, [key, "__k"]).select(key, "before", "after")


def resolved(references: DataFrame, name: str, known: DataFrame, prefix: str) -> DataFrame:
    """references with id: that of a known node (name, id), else the name qualified as a new one."""
    return references.join(known.select(F.col("name").alias(name), F.col("id").alias("__id")), name, "left").withColumn("id", F.coalesce("__id", F.concat(F.lit(prefix), F.col(name)))).drop("__id")


def exactly_one(wanted: DataFrame, objects: DataFrame, keys: list[str], id_col: str, out: str) -> DataFrame:
    """wanted with ``out`` where exactly one object has its keys, and ``out_reason``: unknown or ambiguous, else null."""
    counts = objects.groupBy(*keys).agg(F.countDistinct(id_col).alias("__n"), F.min(id_col).alias("__id"))
    found = wanted.join(counts, keys, "left")
    reason = F.when(F.col("__n").isNull(), "unknown").when(F.col("__n") > 1, "ambiguous")
    return found.withColumns({out: F.when(F.col("__n") == 1, F.col("__id")), f"{out}_reason": reason}).drop("__n", "__id")


def statements(triples: DataFrame, objects: DataFrame, predicates: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Relationships of triples(triple_id, frame, owner, subject, predicate, object) and the rejected ones with reasons.

    A predicate must be known; subject and object must each name exactly one of objects(frame, name, object_id)
    of the triple's frame, and not the same one. The first reason counts.
    """
    spark = triples.sparkSession
    names = spark.createDataFrame(list(predicates.items()), "predicate string, type string")
    rows = triples.join(F.broadcast(names), "predicate", "left")  # a row a known predicate
    for end, out in (("subject", "start_id"), ("object", "end_id")):
        rows = exactly_one(rows, objects.withColumnRenamed("name", end), ["frame", end], "object_id", out)
    reason = F.when(F.col("type").isNull(), "unknown_predicate").when(F.col("start_id_reason").isNotNull(), F.concat("start_id_reason", F.lit("_subject"))).when(F.col("end_id_reason").isNotNull(), F.concat("end_id_reason", F.lit("_object"))).when(F.col("start_id") == F.col("end_id"), "self_loop")
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason IS NULL").select(F.concat_ws(":", F.lit("triple"), "triple_id").alias("id"), "start_id", "end_id", "type", "owner")
    return good, rows.where("reason IS NOT NULL").select("triple_id", "reason")


def build(frames: DataFrame, objects: DataFrame, triples: DataFrame, predicates: dict[str, str], medium: str = "Video") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, relationships, rejections) from frames(frame, owner, at), objects(frame, name, object_id) and triples.

    Owners are references; a frame hangs on its owner, follows those of the time before, and shows its objects.
    """
    node = lambda df, id_, label, owner, reference: df.select(id_.cast("string").alias("id"), F.lit(label).alias("label"), owner.cast("string").alias("owner"), F.lit(reference).alias("reference")).distinct()
    seen = objects.join(frames.select("frame", "owner"), "frame")
    nodes = node(frames, F.col("owner"), medium, F.col("owner"), True).union(node(frames, F.col("frame"), "Frame", F.col("owner"), False)).union(node(seen, F.col("object_id"), "Object", F.col("owner"), False))

    def edge(df: DataFrame, kind: str, start: str, end: str) -> DataFrame:
        a, b = F.col(start).cast("string"), F.col(end).cast("string")
        return df.select(F.concat_ws(":", F.lit(kind), a, b).alias("id"), a.alias("start_id"), b.alias("end_id"), F.lit(kind).alias("type"), F.col("owner").cast("string").alias("owner")).distinct()

    good, rejected = statements(triples.join(frames.select("frame", "owner"), "frame"), objects, predicates)
    good = good.select("id", F.col("start_id").cast("string").alias("start_id"), F.col("end_id").cast("string").alias("end_id"), "type", F.col("owner").cast("string").alias("owner"))
    relationships = edge(frames, "HAS_FRAME", "owner", "frame").union(edge(adjacent_pairs(frames, "owner", "at", "frame"), "BEFORE", "before", "after")).union(edge(seen, "SHOWS", "frame", "object_id")).union(good)
    return nodes, relationships, rejected


def bundle_violations(nodes: DataFrame, relationships: DataFrame, base: DataFrame, labels: set[str], reference_labels: set[str], endpoints: dict[str, tuple[set[str], set[str]]], times: DataFrame | None = None) -> DataFrame:
    """(id, reason) for each rule that a node or relationship breaks; no row means that the bundle may be imported.

    base(id, label) is the existing graph; endpoints tells each type's labels; times(id, at), if given, are those
    that BEFORE must ascend by. Ids are unique; references exist in the base under their label and new nodes do
    not; ends are declared, different and of allowed labels; both ends and the relationship have one owner; new
    nodes take part in a relationship.
    """
    spark = nodes.sparkSession
    out = []
    broken = lambda df, test, reason: out.append(df.where(test).select("id", F.lit(reason).alias("reason")))
    # Both are made once for all rules. What relationships are joined by carries their number; ids come back for those that break a rule.
    nodes = saved(nodes)
    relationships = saved(relationships.withColumn("__no", F.monotonically_increasing_id()))
    for df, what in ((nodes, "node"), (relationships, "relationship")):
        twice = saved(df.where("id IS NOT NULL").groupBy(F.xxhash64("id").alias("__h")).agg(F.count("*").alias("n")).where("n > 1").select("__h"))
        few = F.broadcast(twice) if twice.limit(FEW + 1).count() <= FEW else twice
        broken(df, F.col("id").isNull(), f"repeated_{what}")
        maybe = df.where("id IS NOT NULL").select("id", F.xxhash64("id").alias("__h")).join(few, "__h", "left_semi")
        broken(maybe.groupBy("id").agg(F.count("*").alias("n")), F.col("n") > 1, f"repeated_{what}")
    broken(nodes, ~F.col("label").isin(*labels, *reference_labels) | (F.col("reference") != F.col("label").isin(*reference_labels)), "label")
    known = nodes.join(base.select("id", F.col("label").alias("base_label")), "id", "left")
    broken(known, F.col("reference") & ~F.coalesce(F.col("base_label") == F.col("label"), F.lit(False)), "unknown_reference")
    broken(known, ~F.col("reference") & F.col("base_label").isNotNull(), "existing_id")
    one = nodes.groupBy("id").agg(F.first("label").alias("label"), F.first("owner").alias("owner"), F.first("reference").alias("reference"))
    faults = []
    ends = relationships.select("__no", "start_id", "end_id", "type", "owner")
    for end in ("start", "end"):
        ends = ends.join(one.select(F.col("id").alias(f"{end}_id"), F.col("label").alias(f"{end}_label"), F.col("owner").alias(f"{end}_owner"), F.col("reference").alias(f"{end}_reference")), f"{end}_id", "left")
    rules = spark.createDataFrame([(t, a, b) for t, (x, y) in endpoints.items() for a in x for b in y], "type string, start_label string, end_label string").withColumn("allowed", F.lit(True))
    ends = ends.join(F.broadcast(rules), ["type", "start_label", "end_label"], "left")
    both = F.col("start_label").isNotNull() & F.col("end_label").isNotNull()
    faults.append((~F.col("type").isin(*endpoints), "type"))
    faults.append((~both, "dangling"))
    faults.append((F.col("start_id") == F.col("end_id"), "self_loop"))
    faults.append((both & F.col("type").isin(*endpoints) & F.col("allowed").isNull(), "endpoint_label"))
    foreign = lambda end: ~F.col(f"{end}_owner").eqNullSafe(F.col("owner"))
    faults.append((both & (foreign("start") | foreign("end")), "owner"))
    reasons = F.filter(F.array(*[F.when(test, F.lit(reason)) for test, reason in faults]), lambda x: x.isNotNull())
    met = ends.select("__no", reasons.alias("__r")).where(F.size("__r") > 0).select("__no", F.explode("__r").alias("reason"))
    if times is not None:
        timed = relationships.where("type = 'BEFORE'").select("__no", "start_id", "end_id")
        for end in ("start", "end"):
            timed = timed.join(times.select(F.col("id").alias(f"{end}_id"), F.col("at").alias(f"{end}_at")), f"{end}_id", "left")
        met = met.union(timed.where(~F.coalesce(F.col("start_at") < F.col("end_at"), F.lit(False))).select("__no", F.lit("order")))
    met = saved(met)
    found = F.broadcast(met) if met.limit(FEW + 1).count() <= FEW else met
    out.append(relationships.select("id", "__no").join(found, "__no").select("id", "reason"))
    used = relationships.select(F.explode(F.array("start_id", "end_id")).alias("id")).distinct()
    broken(nodes.where("NOT reference").select("id").join(used, "id", "left_anti"), F.lit(True), "unattached")
    return reduce(DataFrame.union, out).distinct()


def entity_candidates(observations: DataFrame, id_col: str, text_cols: list[str], entities: DataFrame) -> DataFrame:
    """(id, entity_id, alias) where a text names an alias of entities(entity_id, alias) as whole words, ideographs anywhere.

    Aliases go out in automata of bounded size; no word of a text is dealt by, however many texts hold it.
    """
    from ..functions.text import key
    from .matching import named

    texts = observations.select(id_col, F.explode(F.array(*[key(F.col(c)) for c in text_cols])).alias("__t")).where("__t IS NOT NULL")
    names = entities.select("entity_id", "alias", key(F.col("alias")).alias("__a"))
    whole = F.regexp_replace("__t", r"[^\p{L}\p{N}'’-]+", " ")
    return named(names, "__a", ["entity_id", "alias"], texts, id_col, whole, F.col("__t"), F.col("__a").rlike("[一-鿿]")).distinct()


def visual_triples(observations: DataFrame, id_col: str, fields: dict[str, str], usable: Column) -> DataFrame:
    """(id, predicate, object, status): one row for each given field, 'unusable' where the observation is."""
    parts = F.array(*[F.struct(F.lit(p).alias("predicate"), F.col(c).cast("string").alias("object")) for c, p in fields.items()])
    rows = observations.withColumn("__s", F.when(F.coalesce(usable, F.lit(False)), "candidate").otherwise("unusable"))
    return rows.select(id_col, F.explode(F.filter(parts, lambda x: x["object"].isNotNull())).alias("x"), "__s").select(id_col, "x.predicate", "x.object", F.col("__s").alias("status"))


def reused(wanted: DataFrame, earlier: DataFrame, key: str, content: str, valid: Column) -> DataFrame:
    """wanted(key, content) with action: copy what an earlier run has of the same content and in order, reject what is
    not in order, and make anew what is unknown or changed."""
    known = earlier.select(key, F.col(content).alias("__c"), F.coalesce(valid, F.lit(False)).alias("__ok"))
    joined = wanted.join(known, key, "left")
    action = F.when(F.col("__ok").isNull(), "make").when(~F.col("__c").eqNullSafe(F.col(content)), "make").when(F.col("__ok"), "copy").otherwise("reject")
    return joined.withColumn("action", action).drop("__c", "__ok")


def paths(direct: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(owner, member, node_ids, relations, source): one-step paths of direct(owner, member, type) and two-step ones of
    first(owner, middle, type) and second(middle, member, type, source)."""
    one = direct.select("owner", "member", F.array("owner", "member").alias("node_ids"), F.array("type").alias("relations"), F.lit(None).cast("string").alias("source"))
    two = first.withColumnRenamed("type", "__t").join(second, "middle").select("owner", "member", F.array("owner", "middle", "member").alias("node_ids"), F.array("__t", "type").alias("relations"), F.col("source").cast("string").alias("source"))
    return one.unionByName(two)


def evidence_triples(records: DataFrame, id_col: str, lists: dict[str, str], values: dict[str, str], missing: str) -> DataFrame:
    """(triple_id, subject, predicate, object): each member of the list columns by its place, each value or what stands for none."""
    member = lambda c, p: F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x, i: F.struct(F.concat_ws(":", F.col(id_col), F.lit(c), i).alias("triple_id"), F.lit(p).alias("predicate"), x.cast("string").alias("object")))
    value = lambda c, p: F.array(F.struct(F.concat_ws(":", F.col(id_col), F.lit(c)).alias("triple_id"), F.lit(p).alias("predicate"), F.coalesce(F.col(c).cast("string"), F.lit(missing)).alias("object")))
    every = F.concat(*[member(c, p) for c, p in lists.items()], *[value(c, p) for c, p in values.items()])
    return records.select(F.col(id_col).alias("subject"), F.explode(every).alias("x")).select("x.triple_id", "subject", "x.predicate", "x.object")
