"""Answers that walk through whole recipes, and recommendations before they are shown: held against what they were made from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import numbers
from .audit import violations
from .constraints import Constraints, eligible
from .scans import Ranges, plain

#: The longest paraphrase, most citations of a step, and the ideographs one of which it must hold.
MAX_TEXT, MAX_CITATIONS, IDEOGRAPH = 4000, 8, "[\\x{4e00}-\\x{9fff}]"


def _reasons(rules: dict[str, Column]) -> Column:
    """The names of the tests that are true; a test that is null is not."""
    return F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in rules.items()]), lambda x: x.isNotNull())


def walk_violations(choices: DataFrame, steps: DataFrame, evidence: DataFrame, limit: int) -> DataFrame:
    """(answer_id, place, position, reason) for what is wrong with answers that retell recipes step by step.

    choices(answer_id, place, recipe_id, position, step_id, text, citations): a row a step that an answer tells, its
    recipe at a place of the answer, positions from 1. steps(recipe_id, order, step_id, text, source_id) are the recipes',
    evidence(evidence_id, kind, recipe_id, step_id, source_id) what may be cited. An answer has 1 to ``limit`` recipes, each known and
    once, and of each all steps in their order; a text is not blank, at most MAX_TEXT long, with an ideograph, and has no
    number that the step lacks; a step has 1 to MAX_CITATIONS citations, known, none twice, all of that very step and source.
    Reasons of a recipe have no position, those of an answer neither place nor position. A step behind a recipe's last is
    'reordered_step'; nulls are blank texts, no citations, unknown ids. Recipes may have any number of steps.
    """
    told = plain(Ranges(steps.where("recipe_id IS NOT NULL").select("recipe_id", "order", F.col("step_id").alias("__step"), F.col("text").alias("__text"), F.col("source_id").alias("__source")), ["recipe_id"], "order", "__step").numbered("position"))
    none = F.array().cast("array<string>")
    rows = choices.select("answer_id", "place", "recipe_id", F.col("position").cast("long").alias("position"), "step_id", "text", F.coalesce("citations", none).alias("citations"))
    cited = rows.select("answer_id", "place", "recipe_id", "position", "step_id", F.explode("citations").alias("evidence_id"))
    held = evidence.select("evidence_id", "kind", F.col("recipe_id").alias("__r"), F.col("step_id").alias("__s"), F.col("source_id").alias("__o"), F.lit(True).alias("__there"))
    where = ["answer_id", "place", "recipe_id", "position"]
    owner = told.select("recipe_id", "position", F.col("__step").alias("__mine"), F.col("__source").alias("__from"))
    checked = cited.join(held, "evidence_id", "left").join(owner, ["recipe_id", "position"], "left")
    right = (F.col("kind") == "step") & (F.col("__r") == F.col("recipe_id")) & (F.col("__s") == F.col("__mine")) & F.col("__o").eqNullSafe(F.col("__from"))
    foreign = F.col("__there") & F.col("__mine").isNotNull() & ~F.coalesce(right, F.lit(False))
    by_step = checked.groupBy(*where).agg(F.count_if(F.col("__there").isNull()).alias("__unknown"), F.count_if(foreign).alias("__foreign"))
    known = rows.join(told, ["recipe_id", "position"], "left").join(by_step, where, "left")
    n = F.size("citations")
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    of_steps = known.select(
        "answer_id", "place", "position",
        F.explode(_reasons({
            "reordered_step": ~F.coalesce(F.col("__step") == F.col("step_id"), F.lit(False)),
            "text": blank | (F.length("text") > MAX_TEXT) | ~F.coalesce(F.col("text").rlike(IDEOGRAPH), F.lit(False)),
            "citations": (n < 1) | (n > MAX_CITATIONS) | (n != F.size(F.array_distinct("citations"))),
            "unknown_citation": (F.col("__unknown") > 0) | F.exists("citations", lambda x: x.isNull()),
            "citation_source": F.col("__foreign") > 0,
            "unsupported_number": F.col("__step").isNotNull() & (F.size(F.array_except(F.coalesce(numbers(F.col("text")), none), F.coalesce(numbers(F.col("__text")), none))) > 0),
        })).alias("reason"),
    )
    sizes = steps.groupBy("recipe_id").agg(F.count("*").alias("__size"))
    parts = rows.groupBy("answer_id", "place", "recipe_id").agg(F.count("*").alias("__n"), F.countDistinct("position").alias("__d")).join(sizes, "recipe_id", "left")
    uses = parts.groupBy("answer_id", "recipe_id").agg(F.count("*").alias("__uses"))
    parts = parts.join(uses, ["answer_id", "recipe_id"], "left")
    of_recipes = parts.select("answer_id", "place", F.lit(None).cast("long").alias("position"), F.explode(_reasons({"unknown_recipe": F.col("__size").isNull(), "repeated_recipe": F.col("__uses") > 1, "incomplete_steps": (F.col("__n") != F.col("__size")) | (F.col("__d") != F.col("__size"))})).alias("reason"))
    counts = parts.groupBy("answer_id").agg(F.count("*").alias("__n"))
    of_answers = counts.where(F.col("__n") > limit).select("answer_id", F.lit(None).cast(rows.schema["place"].dataType).alias("place"), F.lit(None).cast("long").alias("position"), F.lit("recipe_count").alias("reason"))
    return of_steps.union(of_recipes).union(of_answers)


def output_violations(recommended: DataFrame, candidates: DataFrame, facts: DataFrame, evidence: DataFrame, demands: Constraints) -> DataFrame:
    """(question, recipe_id, reason) of recommendations that do not pass the demands once more.

    recommended(question, recipe_id, steps, members, minutes, evidence_ids); candidates(question, recipe_id) is what the
    search gave; facts(recipe_id, steps, members, extras, minutes, tags, name) the recipes; evidence(question, evidence_id) what was handed
    out. Reasons: 'demands', 'candidate', 'evidence', 'details' (steps, members, minutes as recorded). A recipe without facts
    breaks demands and details; null or no evidence ids are none.
    """
    fact = facts.select("recipe_id", F.struct("steps", "members", "extras", "minutes", "tags", "name").alias("f"), F.lit(True).alias("__known"))
    found = candidates.select("question", "recipe_id").distinct().withColumn("__candidate", F.lit(True))
    cited = recommended.select("question", "recipe_id", F.explode("evidence_ids").alias("evidence_id"))
    loose = cited.join(evidence.select("question", "evidence_id").distinct(), ["question", "evidence_id"], "left_anti").groupBy("question", "recipe_id").agg(F.count("*").alias("__loose"))
    rows = recommended.join(fact, "recipe_id", "left").join(found, ["question", "recipe_id"], "left").join(loose, ["question", "recipe_id"], "left")
    f = F.col("f")
    fits = eligible(demands, members=f["members"], extras=f["extras"], value=f["minutes"], tags=f["tags"], name=f["name"])
    same = F.col("__known") & F.col("steps").eqNullSafe(f["steps"]) & F.col("members").eqNullSafe(f["members"]) & F.col("minutes").eqNullSafe(f["minutes"])
    key = F.struct("question", "recipe_id").alias("k")
    broken = violations(rows.withColumn("k", key), "k", {"demands": F.col("__known") & fits, "candidate": F.col("__candidate"), "evidence": F.coalesce("__loose", F.lit(0)) == 0, "details": same})
    return broken.select("k.question", "k.recipe_id", "reason")
