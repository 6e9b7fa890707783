"""Answers over evidence: the context that is handed out, and what is wrong with what comes back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import numbers

MAX_TEXT, MAX_CITATIONS, MAX_PARAGRAPHS = 1800, 16, 6


def context(candidates: DataFrame, steps: DataFrame, budget: int) -> DataFrame:
    """(question, rank, owner, step, evidence_id, text, status): every step of a question's candidates, numbered E1, E2, ...

    candidates(question, owner, rank), steps(owner, step, text, source, owned): a candidate without steps, a
    repeated place, an empty text or a source that is not the owner's spoils its question, as does a context
    longer than the budget; status says which comes first, or 'ok'.
    """
    each = steps.groupBy("owner").agg(F.count("*").alias("__n"), F.countDistinct("step").alias("__k"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("__blank"), F.count_if(~F.coalesce("owned", F.lit(False))).alias("__foreign"))
    state = candidates.join(each, "owner", "left")
    fault = F.when(F.col("__n").isNull(), "missing_steps").when(F.col("__n") != F.col("__k"), "repeated_step").when(F.col("__blank") > 0, "empty_text").when(F.col("__foreign") > 0, "foreign_source")
    by_question = state.withColumn("__fault", fault).groupBy("question").agg(F.min_by("__fault", F.when(F.col("__fault").isNotNull(), F.col("rank"))).alias("__fault"))
    rows = candidates.join(steps, "owner").select("question", "rank", "owner", "step", "text")
    w = Window.partitionBy("question").orderBy("rank", "step", "text")  # one question's few candidates
    rows = rows.withColumn("evidence_id", F.concat(F.lit("E"), F.row_number().over(w)))
    size = rows.groupBy("question").agg(F.sum(F.length("text")).alias("__size"))
    status = F.coalesce(F.col("__fault"), F.when(F.col("__size") > budget, "over_budget"), F.lit("ok"))
    return rows.join(by_question, "question").join(size, "question").withColumn("status", status).drop("__fault", "__size")


def answer_violations(paragraphs: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, place, reason) of paragraphs(answer_id, place, text, citations) held against evidence(evidence_id, step, text).

    Texts are neither empty, overlong nor numbered; citations are known, not repeated and at most MAX_CITATIONS;
    a step that is named must be a cited one's place, and every other number must stand in a cited text.
    """
    rows = paragraphs.withColumn("__said", F.regexp_replace("text", r"第\s*[0-9]+\s*步", "所引步骤"))
    rows = rows.withColumns({"__steps": F.regexp_extract_all("text", F.lit(r"第\s*([0-9]+)\s*步"), F.lit(1)), "__numbers": numbers(F.col("__said"))})
    cited = paragraphs.select("answer_id", "place", F.explode("citations").alias("evidence_id")).distinct()
    held = cited.join(evidence.select("evidence_id", F.col("step").cast("string").alias("__step"), numbers(F.col("text")).alias("__held")), "evidence_id", "left")
    none = F.array().cast("array<string>")
    held = held.groupBy("answer_id", "place").agg(F.count_if(F.col("__step").isNull()).alias("__unknown"), F.collect_set("__step").alias("__orders"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("__held", none)))).alias("__held"))
    rows = rows.join(held, ["answer_id", "place"], "left")
    n_paragraphs = F.count("*").over(Window.partitionBy("answer_id"))
    size = F.size(F.coalesce("citations", none))
    rules = {
        "text": (F.trim(F.coalesce("text", F.lit(""))) == "") | (F.length("text") > MAX_TEXT) | F.col("text").rlike(r"^\s*(?:[0-9]+\s*[.)、:]|第[0-9]+步)"),
        "citations": (size < 1) | (size > MAX_CITATIONS) | (size != F.size(F.array_distinct(F.coalesce("citations", none)))),
        "unknown_citation": F.col("__unknown") > 0,
        "unsupported_step": F.size(F.array_except("__steps", F.coalesce("__orders", none))) > 0,
        "unreadable_number": F.col("__numbers").isNull() & F.col("text").isNotNull(),
        "unsupported_number": F.size(F.array_except("__numbers", F.coalesce("__held", none))) > 0,
        "paragraphs": F.col("__count") > MAX_PARAGRAPHS,
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(n)) for n, test in rules.items()]), lambda x: x.isNotNull())
    return rows.withColumn("__count", n_paragraphs).select("answer_id", "place", F.explode(broken).alias("reason"))


def selection_violations(selections: DataFrame, evidence: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(answer_id, place, reason) of selections(answer_id, place, owner, reasons, citations) against evidence(evidence_id, owner, kind).

    An answer selects an owner once; reasons are known and not repeated; citations are known and the owner's own;
    each reason has a cited evidence of the kind that it needs.
    """
    none = F.array().cast("array<string>")
    cited = selections.select("answer_id", "place", F.col("owner").alias("__o"), F.explode("citations").alias("evidence_id")).distinct()
    held = cited.join(evidence.select("evidence_id", F.col("owner").alias("__of"), F.col("kind").alias("__kind")), "evidence_id", "left").groupBy("answer_id", "place").agg(F.count_if(F.col("__of").isNull()).alias("__unknown"), F.count_if(F.col("__of") != F.col("__o")).alias("__foreign"), F.collect_set("__kind").alias("__kinds"))
    rows = selections.join(held, ["answer_id", "place"], "left").withColumn("__times", F.count("*").over(Window.partitionBy("answer_id", "owner")))
    needs = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    needed = F.transform(F.filter("reasons", lambda r: r.isin(*kinds)), lambda r: F.element_at(needs, r))
    repeated = lambda c: F.size(F.col(c)) != F.size(F.array_distinct(c))
    rules = {
        "repeated_owner": F.col("__times") > 1,
        "reasons": (F.size("reasons") < 1) | repeated("reasons") | (F.size(F.filter("reasons", lambda r: ~r.isin(*kinds))) > 0),
        "citations": (F.size("citations") < 1) | (F.size("citations") > MAX_CITATIONS) | repeated("citations"),
        "unknown_citation": F.col("__unknown") > 0,
        "foreign_citation": F.col("__foreign") > 0,
        "unsupported_reason": F.size(F.array_except(needed, F.coalesce("__kinds", none))) > 0,
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(n)) for n, test in rules.items()]), lambda x: x.isNotNull())
    return rows.select("answer_id", "place", F.explode(broken).alias("reason"))


def detail_violations(details: DataFrame, id_col: str, steps: str, title: Column, sources: Column) -> DataFrame:
    """(id, reason) of records with an array of step numbers: without title, steps or sources, with gaps or repeats."""
    places = F.col(steps)
    rules = {
        "no_title": F.trim(F.coalesce(title, F.lit(""))) == "",
        "no_steps": F.size(F.coalesce(places, F.array().cast("array<int>"))) == 0,
        "repeated_step": F.size(places) != F.size(F.array_distinct(places)),
        "gap": (F.size(places) > 0) & (F.array_max(places) != F.size(F.array_distinct(places))),
        "no_source": F.coalesce(sources, F.lit(0)) == 0,
    }
    broken = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(n)) for n, test in rules.items()]), lambda x: x.isNotNull())
    return details.select(F.col(id_col), F.explode(broken).alias("reason"))


def markers(title: Column, listed: list[str]) -> Column:
    """The literal marks of poor quality that a title holds, in listed order."""
    return F.filter(F.array(*[F.lit(m) for m in listed]), lambda m: F.contains(F.lower(title), F.lower(m)))
