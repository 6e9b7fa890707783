"""Constraint algebra: column predicates over arrays, relational division over edges, deterministic ranks."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Constraints:
    """What a query asks; an empty field asks nothing."""

    available: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    at_most: float | None = None
    required_tags: tuple[str, ...] = ()
    name_part: str | None = None
    allow_missing: bool = False
    top_k: int = 10

    def tightened(self, other: Constraints) -> Constraints:
        """Both together: unions of demands, the smaller bound, never anything looser."""
        bounds = [b for b in (self.at_most, other.at_most) if b is not None]
        both = lambda a, b: tuple(dict.fromkeys((*a, *b)))
        return Constraints(both(self.available, other.available), both(self.excluded, other.excluded), min(bounds, default=None), both(self.required_tags, other.required_tags), self.name_part or other.name_part, self.allow_missing and other.allow_missing, min(self.top_k, other.top_k))


def words(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def excludes(members: Column, extras: Column, excluded) -> Column:
    """No excluded value among members or extras."""
    return ~F.arrays_overlap(F.array_union(members, extras), words(excluded))


def at_most(value: Column, bound: float | None) -> Column:
    """A given bound fails for an unknown value."""
    return F.lit(True) if bound is None else F.coalesce(value <= bound, F.lit(False))


def has_all(values: Column, required) -> Column:
    return F.coalesce(F.size(F.array_except(words(required), values)) == 0, F.lit(not required))


def missing(members: Column, available) -> Column:
    return F.sort_array(F.array_except(members, words(available)))


def eligible(c: Constraints, *, members: Column, extras: Column, value: Column, tags: Column, name: Column) -> Column:
    """All demands together; the inventory is not asked where only a name is given or missing is allowed."""
    test = excludes(members, extras, c.excluded) if c.excluded else F.lit(True)
    test = test & at_most(value, c.at_most) & has_all(tags, c.required_tags)
    if c.name_part:
        test = test & name.contains(c.name_part)
    if not c.allow_missing and (c.available or not c.name_part):
        test = test & (F.size(F.array_except(members, words(c.available))) == 0)
    return test


def ranked(df: DataFrame, c: Constraints, members: str, value: str, id_col: str) -> DataFrame:
    """Fewest missing, most matched, smallest value (unknown last), id; the first top_k."""
    have = F.size(F.array_intersect(members, words(c.available)))
    lack = F.size(F.array_except(members, words(c.available)))
    return df.withColumns({"missing": lack, "matched": have}).orderBy("missing", F.desc("matched"), F.coalesce(F.col(value), F.lit(10000)), id_col).limit(c.top_k)


def division(edges: DataFrame, owner: str, member: str, terms: dict[str, list[str]]) -> DataFrame:
    """Owners that have, for every term, an edge to one of its aliases (an alias may be several terms'): counted distinct terms, one shuffle."""
    table = edges.sparkSession.createDataFrame([(a, t) for t, aliases in terms.items() for a in aliases], f"`{member}` string, term string")
    found = edges.select(owner, F.col(member)).join(F.broadcast(table), member)  # a row an alias that was asked for
    return found.groupBy(owner).agg(F.countDistinct("term").alias("n")).where(F.col("n") == len(terms)).select(owner)


def without(owners: DataFrame, edges: DataFrame, owner: str, member: str, excluded) -> DataFrame:
    """Owners without any edge to an excluded member."""
    return owners.join(edges.where(F.col(member).isin(list(excluded))).select(owner), owner, "left_anti")


def title_rank(title: Column, phrase: str) -> Column:
    """0 for the very title, 1 where it is contained, else 2."""
    low = F.lower(title)
    return F.when(low == phrase.lower(), 0).when(low.contains(phrase.lower()), 1).otherwise(2)


def first_present(*columns: Column, blank_is_null: bool = False) -> Column:
    return F.coalesce(*[F.nullif(c, F.lit("")) if blank_is_null else c for c in columns])


def reasons(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold, in order."""
    return F.filter(F.array(*[F.when(rule, F.lit(n)) for n, rule in rules.items()]), lambda x: x.isNotNull())


def holds_names(names: Column, aliases: Column, required, excluded) -> Column:
    """Over normalised names and their aliases: every required one is among them, no excluded one is."""
    from ..functions.text import key

    every = F.transform(F.filter(F.concat(names, aliases), lambda x: x.isNotNull()), lambda x: key(x))
    has = lambda x: F.array_contains(every, key(F.lit(x)))
    test = F.lit(True)
    for x in required:
        test = test & has(x)
    for x in excluded:
        test = test & ~has(x)
    return test


def in_scope(nodes: DataFrame, edges: DataFrame, scope: dict[str, object]) -> tuple[DataFrame, DataFrame]:
    """Nodes of a scope and the edges that are of it themselves and between its nodes."""
    for column, value in scope.items():
        nodes, edges = nodes.where(F.col(column).eqNullSafe(F.lit(value))), edges.where(F.col(column).eqNullSafe(F.lit(value)))
    ids = nodes.select("id")
    for end in ("start_id", "end_id"):
        edges = edges.join(ids.select(F.col("id").alias(end)), end, "left_semi")
    return nodes, edges


def kind_rank(title: Column, phrase: str, members: Column) -> Column:
    """0 for the very title, 1 where a member is the phrase, else 2."""
    return F.when(F.lower(title) == phrase.lower(), 0).when(F.array_contains(F.transform(members, lambda x: F.lower(x)), phrase.lower()), 1).otherwise(2)


def shuffled(rows: DataFrame, id_col: str, seed: str, n: int) -> DataFrame:
    """n rows in an order that depends on the seed and the ids alone, with their place."""
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_col).cast("string")).cast("binary"))
    return rows.withColumn("__k", place).orderBy("__k", id_col).limit(n).withColumnRenamed("__k", "shuffle_key")


def holds_credential(text: Column) -> Column:
    """A text that shows an access key or a secret's assignment is not handed out."""
    return F.coalesce(text.rlike(r"\bsk-[A-Za-z0-9_-]{8,}|AKIA[A-Z0-9]{16}|(?i)\b(?:api_?key|password|secret|token)\b[\"']?\s*[:=]\s*[\"']?[A-Za-z0-9+/_.=-]{6,}"), F.lit(False))


def of_kind(parts: Column, kind: str, wanted) -> Column:
    """Nested elements of the wanted kinds only."""
    return F.filter(parts, lambda x: x[kind].isin(*wanted))
