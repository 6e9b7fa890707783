"""How far a run over many work items has come: what was claimed against what is expected and what the graph holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ("images", "videos", "clips", "frames", "observations", "aligned")
#: What the graph is asked about a run, beside its media.
HELD = ("clips", "frames", "observations", "aligned", "nodes", "edges")


def _broken(rules: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(~F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())


def item_states(expected: DataFrame, items: DataFrame, held: DataFrame) -> DataFrame:
    """(item, state, reasons) of every expected item, every item that nobody expects and every run of no item.

    expected(item, images, videos, media_ids); items(item, status, run_id, images, videos, clips, frames, observations, aligned,
    nodes, edges, observation_ids) is what the run says; held(run_id, media_ids, clips, frames, observations, aligned, nodes, edges) what
    the graph holds. An item that says 'verified' is so only if nothing speaks against it: its counts are there and
    not negative, its media are the expected ones, an observation is of an image or a clip and has its own id, a video has a clip and a clip a
    frame, its run is no other item's, and the graph holds the same. Else it is 'inconsistent'. 'failed' stays failed; all else is 'pending',
    as is an item of which nothing was said. Unexpected items and runs are 'unexpected', a run under 'run:' and its id.
    held has a row a run. Of an item told more than once each telling is judged and says 'repeated'. Null ids are nobody's.
    """
    mine = items.select("item", F.lit(True).alias("__said"), "status", "run_id", "observation_ids", *[F.col(c).alias(f"__{c}") for c in (*COUNTS, "nodes", "edges")]).where("item IS NOT NULL")
    claims = mine.where("status = 'verified' AND run_id IS NOT NULL").groupBy("run_id").agg(F.count("*").alias("__claims"))
    told = mine.groupBy("item").agg(F.count("*").alias("__told"))
    graph = held.where("run_id IS NOT NULL").select("run_id", F.lit(True).alias("__run"), F.col("media_ids").alias("__media"), *[F.col(c).alias(f"__held_{c}") for c in HELD])
    want = expected.where("item IS NOT NULL").select("item", F.lit(True).alias("__wanted"), "images", "videos", "media_ids")
    rows = want.join(mine, "item", "full").join(told, "item", "left").join(claims, "run_id", "left").join(graph, "run_id", "left")
    c = {n: F.col(f"__{n}") for n in (*COUNTS, "nodes", "edges")}
    all_there = F.forall(F.array(*[x.cast("long") for x in c.values()]), lambda x: F.coalesce(x >= 0, F.lit(False)))
    ids = F.coalesce("observation_ids", F.array().cast("array<string>"))
    same_set = lambda a, b: F.array_sort(F.array_distinct(F.col(a))) == F.array_sort(F.array_distinct(F.col(b)))
    rules = {
        "repeated": F.col("__told") == 1,
        "counts": all_there,
        "media": (c["images"] == F.col("images")) & (c["videos"] == F.col("videos")),
        "observations": c["observations"] == c["images"] + c["clips"],
        "aligned": c["aligned"] <= c["observations"],
        "windows": (c["clips"] >= c["videos"]) & (c["frames"] >= c["clips"]) & ((c["videos"] > 0) | ((c["clips"] == 0) & (c["frames"] == 0))),
        "observation_ids": (F.size(ids) == c["observations"]) & (F.size(F.array_distinct(ids)) == F.size(ids)) & F.forall(ids, lambda x: F.coalesce(x != "", F.lit(False))),
        "run": (F.trim("run_id") != "") & (F.col("__claims") == 1),
        "graph": F.col("__run") & F.forall(F.array(*[F.col(f"__held_{n}").eqNullSafe(c[n]) for n in HELD]), lambda x: x),
        "graph_media": F.col("__run") & same_set("__media", "media_ids"),
    }
    verified = F.coalesce(F.col("status") == "verified", F.lit(False))
    none = F.array().cast("array<string>")
    out = rows.withColumn("reasons", F.when(F.col("__wanted") & verified, _broken(rules)).otherwise(none))
    state = F.when(F.col("__wanted").isNull(), "unexpected").when(verified, F.when(F.size("reasons") == 0, "verified").otherwise("inconsistent")).when(F.col("status") == "failed", "failed").otherwise("pending")
    runs = graph.join(mine.where("status = 'verified'").select("run_id"), "run_id", "left_anti").select(F.concat(F.lit("run:"), "run_id").alias("item"), F.lit("unexpected").alias("state"), none.alias("reasons"))
    return out.select(F.col("item").cast("string").alias("item"), state.alias("state"), "reasons").union(runs)


def scope_progress(states: DataFrame, expected: DataFrame, claimed: DataFrame) -> DataFrame:
    """(name, claimed, found, agrees) of a run's own totals: claimed(name, n) against the items' states, null for what was not claimed.

    Names: expected, verified, inconsistent, failed, pending, unexpected, images and videos (of verified items), and
    complete, which is 1 if every expected item is verified and nothing is unexpected. An empty scope is complete.
    """
    kinds = ("verified", "inconsistent", "failed", "pending", "unexpected")
    counts = states.groupBy("item", "state").agg(F.count("*").alias("n")).join(expected.select(F.col("item").cast("string").alias("item"), "images", "videos"), "item", "left")
    of = lambda c: F.coalesce(F.sum(F.when(F.col("state") == "verified", F.col(c))), F.lit(0)).cast("long")
    totals = counts.agg(*[F.coalesce(F.sum(F.when(F.col("state") == k, F.col("n"))), F.lit(0)).cast("long").alias(k) for k in kinds], of("images").alias("images"), of("videos").alias("videos"), F.countDistinct(F.when(F.col("state") != "unexpected", F.col("item"))).alias("expected"))
    totals = totals.withColumns({"complete": (F.col("inconsistent") + F.col("failed") + F.col("pending") + F.col("unexpected") == 0).cast("long")})
    names = ("expected", *kinds, "images", "videos", "complete")
    found = totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("found")) for n in names])).alias("x")).select("x.*")
    said = claimed.groupBy("name").agg(F.max("n").alias("claimed"), F.min("n").alias("__least"))
    out = found.join(said, "name", "full").withColumn("agrees", F.col("claimed").eqNullSafe(F.col("found")) & F.col("__least").eqNullSafe(F.col("claimed")))
    return out.select("name", F.col("claimed").cast("long").alias("claimed"), "found", "agrees")
