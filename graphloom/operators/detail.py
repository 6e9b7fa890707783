"""A recipe's whole detail read back as one nested row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import saved
from .evidence import branches, first_by, ordered_list

#: Types of the graph's relationships and an alignment's way.
STEP, SOURCE, INGREDIENT, IMAGE, VIDEO, ALIGNED = "HAS_STEP", "HAS_SOURCE", "HAS_INGREDIENT", "HAS_IMAGE", "HAS_VIDEO", "ALIGNED_WITH"
#: Tables of so many rows go out to all tasks.
FEW = 1 << 18


def recipe_detail(recipes: DataFrame, links: DataFrame, steps: DataFrame, sources: DataFrame, ingredients: DataFrame, media: DataFrame, observations: DataFrame, runs: DataFrame) -> DataFrame:
    """(id, recipe, steps, sources, ingredient_mentions, media, visual_evidence): a row for each row of recipes.

    links(start_id, end_id, type, role, method, run_id, score) are the graph's relationships; steps(id, order, text, source_id),
    sources(id, ...), ingredients(id, name), media(id, kind, source_id, downloaded, storage, recognition), observations(id, media_id,
    source_id, run_id, caption), runs(run_id, finished_at). Steps come by order and id, sources by role and id, ingredients by
    name and id, media by id with their source; of an image the observation of the run that finished last (unknown
    ends last, then the greatest id), if it is of the image's own source, with every step of this recipe that the same run aligned the image with.
    A relationship told twice counts once; what a relationship names and no table holds is left out; a recipe with none has
    empty lists. Every branch is aggregated before it is joined, so no branch multiplies another. One recipe's detail
    is one row: give the recipes that are asked for.
    """
    few = lambda df: F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df
    asked = recipes.select(F.col("id").alias("__recipe")).distinct()
    all_of_them = asked.limit(FEW + 1).count() > FEW  # the others are left out by the last join

    def edges(kinds: Sequence[str], *of_link: str) -> DataFrame:
        """The asked recipes' links, with the recipe as __recipe."""
        rows = links.where(F.col("type").isin(*kinds)).select(F.col("start_id").alias("__recipe"), F.col("end_id").alias("id"), *of_link)
        return rows if all_of_them else rows.join(F.broadcast(asked), "__recipe", "left_semi")

    def ends(kinds: Sequence[str], rows: DataFrame, *of_link: str) -> DataFrame:
        """Rows at the ends of the asked recipes' links: links are dealt once, by their ends, made distinct there and joined."""
        return edges(kinds, *of_link).repartition("id").distinct().join(rows, "id")

    def listed(df: DataFrame, name: str, order: list[str], columns: list[str]) -> DataFrame:
        return df.groupBy("__recipe").agg(ordered_list(order, *columns).alias(name))

    # An image's observation does not depend on the recipe; only alignments of its run go on.
    own = media.where("kind = 'image'").select(F.col("id").alias("media_id"), F.col("source_id").alias("__own")).distinct()
    seen = observations.select(F.col("id").alias("observation_id"), "media_id", F.col("source_id").alias("__from"), "run_id", "caption").join(few(runs.select("run_id", "finished_at")), "run_id", "left")
    latest = saved(first_by(own.join(seen, "media_id").where("__own = __from").drop("__own", "__from"), ["media_id"], F.desc_nulls_last("finished_at"), F.desc("observation_id")))
    aligned = links.where(F.col("type") == ALIGNED).select(F.col("start_id").alias("media_id"), F.col("end_id").alias("id"), "run_id", "score")
    aligned = aligned.join(few(latest.select("media_id", "run_id")), ["media_id", "run_id"], "left_semi").repartition("id").distinct()
    aligned = aligned.groupBy("id").agg(F.collect_list(F.struct("media_id", "run_id", "score")).alias("__aligned"))

    of_steps = ends([STEP], steps.select("id", "order", "text", "source_id")).distinct().join(aligned, "id", "left")
    held = F.flatten(F.transform(F.collect_list(F.when(F.col("__aligned").isNotNull(), F.struct("id", "order", "__aligned"))), lambda s: F.transform(s["__aligned"], lambda a: F.struct(a["media_id"].alias("media_id"), a["run_id"].alias("run_id"), s["order"].alias("step_order"), s["id"].alias("step_id"), a["score"].alias("score")))))
    by_step = of_steps.groupBy("__recipe").agg(ordered_list(["order", "id"], "text", "source_id").alias("steps"), held.alias("__held"))

    origin = sources.select(F.col("id").alias("source_id"), F.struct(*sources.columns).alias("source"))
    known = media.select("id", "kind", "source_id", "downloaded", "storage", "recognition").distinct().join(origin, "source_id", "left")
    known = known.join(latest.select(F.col("media_id").alias("id"), F.struct("media_id", "observation_id", "run_id", "caption", "finished_at").alias("__seen")), "id", "left")
    # Media are few beside their links, which are dealt by recipe before they get wide.
    shown = edges([IMAGE, VIDEO], "type").repartition("__recipe").groupBy("__recipe", "id").agg(F.max(F.col("type") == IMAGE).alias("__image"))
    pictures = shown.join(few(known), "id")
    n = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    kind, there = F.col("kind"), F.col("downloaded")
    counts = {"images": n(kind == "image"), "videos": n(kind == "video"), "downloaded_images": n((kind == "image") & there), "downloaded_videos": n((kind == "video") & there), "recognition_not_run": n(F.col("recognition") == "not_run"), "storage_modes": F.array_sort(F.collect_set("storage")), "inventory": ordered_list(["id"], "kind", "source_id", "storage", "source")}
    of_media = pictures.groupBy("__recipe").agg(F.struct(*[c.alias(name) for name, c in counts.items()]).alias("media"), F.collect_set(F.when(F.col("__image"), F.col("__seen"))).alias("__seen"))

    out = branches(
        recipes.select("id", F.struct(*recipes.columns).alias("recipe")).withColumn("__recipe", F.col("id")),
        "__recipe",
        by_step,
        listed(ends([SOURCE], sources, "role"), "sources", ["role", "id"], [c for c in sources.columns if c not in ("id", "role")]),
        listed(ends([INGREDIENT], ingredients.select("id", "name"), "method"), "ingredient_mentions", ["name", "id"], ["method"]),
        of_media,
    )

    def told(v: Column) -> Column:
        """An observation with each step that its run aligned the image with, or alone."""
        row = lambda h: F.struct(v["media_id"].alias("media_id"), v["observation_id"].alias("observation_id"), h["step_order"].alias("step_order"), h["step_id"].alias("step_id"), v["run_id"].alias("run_id"), v["caption"].alias("caption"), v["finished_at"].alias("finished_at"), h["score"].alias("score"))
        mine = F.filter(F.coalesce("__held", F.array().cast(out.schema["__held"].dataType)), lambda h: (h["media_id"] == v["media_id"]) & (h["run_id"] == v["run_id"]))
        none = F.lit(None).cast(out.schema["__held"].dataType.elementType)
        return F.transform(F.when(F.size(mine) > 0, mine).otherwise(F.array(none)), row)

    out = out.withColumn("visual_evidence", F.sort_array(F.flatten(F.transform("__seen", told))))
    empty = lambda name: F.coalesce(name, F.array().cast(out.schema[name].dataType)).alias(name)
    none = F.struct(*[(F.array() if f.dataType.typeName() == "array" else F.lit(0)).cast(f.dataType).alias(f.name) for f in out.schema["media"].dataType.fields])
    return out.select("id", "recipe", empty("steps"), empty("sources"), empty("ingredient_mentions"), F.coalesce("media", none).alias("media"), empty("visual_evidence"))
