"""Property graphs as two tables: nodes(id, label, name) and edges(start_id, end_id, type)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uid
from ..runtime import saved

#: Ends of so many ids are looked up where the nodes are; more are dealt.
FEW = 1 << 16


def nodes_of(df: DataFrame, label: str, key: Column) -> DataFrame:
    """Distinct nodes of a label, identified by their key."""
    return df.select(uid(label, key.cast("string")).alias("id"), F.lit(label).alias("label"), key.cast("string").alias("name")).where("name IS NOT NULL").distinct()


def edges_of(df: DataFrame, start: tuple[str, Column], kind: str, end: tuple[str, Column]) -> DataFrame:
    """Distinct edges between keys of two labels."""
    ids = [uid(label, key.cast("string")) for label, key in (start, end)]
    return df.select(ids[0].alias("start_id"), ids[1].alias("end_id"), F.lit(kind).alias("type")).where("start_id IS NOT NULL AND end_id IS NOT NULL").distinct()


def text_graph(records: DataFrame, steps: DataFrame, mentions: DataFrame, relations: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of records(record, title), steps(record, step, text) and mentions(record, step, kind, normalized_name).

    A record has its steps; a step has an edge to each name of a kind that it mentions, of the type that
    ``relations`` gives the kind. Entities are known by kind and name, steps by record and place. What the mentions tell is
    written once, for the nodes and the edges that come of it.
    """
    record = uid("record", F.col("record").cast("string"))
    step = uid("step", F.concat_ws(":", "record", "step"))
    entity = uid("entity", F.concat_ws(":", "kind", "normalized_name"))
    kinds = F.create_map(*[F.lit(x) for pair in relations.items() for x in pair])
    told = mentions.where(F.col("kind").isin(list(relations)) & F.col("normalized_name").isNotNull())
    told = saved(told.select("record", "step", "kind", "normalized_name").distinct())  # texts are read for mentions once, whatever uses the graph
    nodes = records.select(record.alias("id"), F.lit("Record").alias("label"), F.col("title").alias("name"))
    nodes = nodes.union(steps.select(step, F.lit("Step"), F.col("text"))).union(told.select(entity, F.initcap("kind"), F.col("normalized_name")).distinct())
    edges = steps.select(record.alias("start_id"), step.alias("end_id"), F.lit("HAS_STEP").alias("type"))
    return nodes, edges.union(told.select(step, entity, F.element_at(kinds, F.col("kind"))).distinct())


def candidate_index(nodes: DataFrame, edges: DataFrame, owner_label: str, step_type: str) -> DataFrame:
    """(owner, kind, name): what an owner's own edges and those of its steps lead to, by normalised name, each once."""
    from ..functions.text import key

    owners = nodes.where(F.col("label") == owner_label).select(F.col("id").alias("owner"))
    links = edges.where(F.col("type") != step_type).select("start_id", "end_id")
    of_step = edges.where(F.col("type") == step_type).select(F.col("start_id").alias("owner"), F.col("end_id").alias("start_id"))
    # Each start's ends travel together, so a step that leads nowhere is left out by one join and an owner's ends are made one row each once.
    ends = links.groupBy("start_id").agg(F.collect_set("end_id").alias("ends"))
    reached = of_step.join(ends, "start_id").select("owner", "ends").union(ends.select(F.col("start_id").alias("owner"), "ends"))
    reached = saved(reached.select("owner", F.explode("ends").alias("end_id")).distinct().join(owners.distinct(), "owner", "left_semi"))
    asked = reached.select("end_id").distinct()
    small = asked.limit(FEW + 1).count() <= FEW
    named = nodes.join(F.broadcast(asked) if small else asked, F.col("id") == F.col("end_id"), "left_semi").select(F.col("id").alias("end_id"), F.col("label").alias("kind"), key(F.col("name")).alias("name")).distinct()
    return reached.join(F.broadcast(named) if small else named, "end_id").select("owner", "kind", "name").distinct()


def traverse(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(start_id, start_name, end_id, end_name) over the edges of one type."""
    a = nodes.select(F.col("id").alias("start_id"), F.col("name").alias("start_name"))
    b = nodes.select(F.col("id").alias("end_id"), F.col("name").alias("end_name"))
    return edges.where(F.col("type") == kind).select("start_id", "end_id").join(a, "start_id").join(b, "end_id")


def rolled_up(first: DataFrame, second: DataFrame, direct: DataFrame | None = None) -> DataFrame:
    """(owner, member): members two steps away, united with direct ones, each once."""
    far = first.join(second, "middle").select("owner", "member")
    return (far if direct is None else far.unionByName(direct.select("owner", "member"))).distinct()


def induced(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges whose both ends are in ids(id)."""
    return edges.join(ids.select(F.col("id").alias("start_id")), "start_id", "left_semi").join(ids.select(F.col("id").alias("end_id")), "end_id", "left_semi").select("start_id", "end_id", "type")


def endpoint_violations(nodes: DataFrame, edges: DataFrame, allowed: list[tuple[str, str, str]]) -> DataFrame:
    """Edges whose (type, start label, end label) is not allowed, or an end of which is missing."""
    spark = edges.sparkSession
    rules = spark.createDataFrame(allowed, "type string, start_label string, end_label string")
    a = nodes.select(F.col("id").alias("start_id"), F.col("label").alias("start_label"))
    b = nodes.select(F.col("id").alias("end_id"), F.col("label").alias("end_label"))
    return edges.join(a, "start_id", "left").join(b, "end_id", "left").join(rules, ["type", "start_label", "end_label"], "left_anti")


def conflicting_nodes(nodes: DataFrame) -> DataFrame:
    """Ids defined with more than one payload."""
    return nodes.groupBy("id").agg(F.countDistinct("label", "name").alias("n_versions")).where("n_versions > 1")


def unique_owner(items: DataFrame, candidates: DataFrame, exact: str, group: str, owner: str) -> DataFrame:
    """items with owner and method: by the exact key, else by the group if it has exactly one candidate."""
    by_key = candidates.select(exact, F.col(owner).alias("__exact")).distinct()
    by_group = candidates.groupBy(group).agg(F.min(owner).alias("__group"), F.countDistinct(owner).alias("__n")).where("__n = 1").drop("__n")
    joined = items.join(by_key, exact, "left").join(by_group, group, "left")
    method = F.when(F.col("__exact").isNotNull(), "exact").when(F.col("__group").isNotNull(), "group").otherwise("none")
    return joined.withColumns({owner: F.coalesce("__exact", "__group"), "method": method}).drop("__exact", "__group")
