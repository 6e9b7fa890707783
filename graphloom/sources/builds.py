"""Sinks: exports, upserts and versioned builds that become active only once they are verified."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import content_hash, content_sums
from .commits import BuildError, Commit, CommitLog

STATUS = "build_id string, status string, n_rows long, content_hash string, number long, at timestamp"


def export_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """CSV of nodes and relationships with their properties as JSON; Spark's commit makes each table appear whole."""
    for name, df, keys in (("nodes", nodes, ["id", "label"]), ("relationships", edges, ["id", "start_id", "end_id", "type"])):
        rest = [c for c in df.columns if c not in keys]
        packed = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
        df.select(*keys, packed.alias("properties_json")).write.option("header", True).option("escape", '"').mode("overwrite").csv(f"{path}/{name}")


def export_lines(df: DataFrame, path: str, compressed: bool = False) -> int:
    """JSON lines; the number of rows. A read-back must give the rows that were written."""
    written, columns = Observation(), sorted(df.columns)
    df.observe(written, *content_sums(columns)).write.mode("overwrite").option("compression", "gzip" if compressed else "none").json(path)
    back = content_hash(df.sparkSession.read.schema(df.schema).json(path), columns).first()
    if back.asDict() != written.get:
        raise BuildError(f"{path} reads back differently")
    return back.n_rows


def _one_payload(incoming: DataFrame, key: str, payload: list[str]) -> None:
    """A key that comes twice with different payloads is an error."""
    if not incoming.groupBy(key).agg(F.countDistinct(F.struct(*payload)).alias("n")).where("n > 1").isEmpty():
        raise BuildError(f"one {key} comes with several payloads")


def upserted(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """existing with incoming rows in place of those of the same key; equal incoming rows count once, unequal ones of a key are an error."""
    _one_payload(incoming, key, [c for c in incoming.columns if c != key])
    incoming = incoming.dropDuplicates([key])
    return existing.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def append_only(existing: DataFrame, incoming: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows of incoming that are new, each once; a key with another payload, known or in the same import, is an error."""
    known = existing.select(key, F.col(payload).alias("__known"))
    clash = incoming.join(known, key).where(~F.col(payload).eqNullSafe(F.col("__known")))
    if not clash.isEmpty():
        raise BuildError(f"a known {key} comes with another {payload}")
    _one_payload(incoming, key, [payload])
    return incoming.dropDuplicates([key]).join(known, key, "left_anti")


def write_report(row: DataFrame, path: str) -> None:
    """One row as one JSON file, which appears whole: a small report, not a table."""
    row.coalesce(1).write.mode("overwrite").json(path)


def append_trace(rows: DataFrame, path: str) -> None:
    """Add rows to a log that is only ever appended to, with the time of writing."""
    rows.withColumn("written_at", F.current_timestamp()).write.mode("append").json(path)


def inventory(found: DataFrame, cached: DataFrame, key: str, fingerprint: str, make) -> DataFrame:
    """The cached rows whose fingerprint is still found, and rows made anew for what is new or changed."""
    same = cached.join(found.select(key, fingerprint), [key, fingerprint], "left_semi")
    return same.unionByName(make(found.join(cached.select(key, fingerprint), [key, fingerprint], "left_anti")))


def todo(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a resumed run still has to do."""
    return items.join(done.select(key), key, "left_anti")


class Builds:
    """Tables of named builds over a log of commits; the newest verified build is active.

    A name is reserved by a commit, so of several publishers of one name one goes on and all others are refused.
    A build's tables are named by one commit only after all were read back, so they appear together or not at all.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.log = spark, CommitLog(spark, path)

    def _state(self, log: list[Commit]) -> dict[str, Commit]:
        """The last commit of each build."""
        return {c.name: c for c in log if c.action in ("importing", "failed", "verified")}

    def status(self) -> DataFrame:
        """The last status of each build; rows and hash are those of its table, or of its tables together."""
        rows = []
        for name, c in self._state(self.log.commits()).items():
            tables = [c.tables[k] for k in sorted(c.tables)]
            hashes = "+".join(t["content_hash"] for t in tables)
            rows.append((name, c.action, sum(t["n_rows"] for t in tables) if tables else None, hashes or None, c.number, datetime.fromtimestamp(c.at)))
        return self.spark.createDataFrame(rows, STATUS)

    def active(self) -> str:
        """The verified build that is newest by its commit; none is an error."""
        found = [c for c in self._state(self.log.commits()).values() if c.action == "verified"]
        if not found:
            raise BuildError("no build is active")
        return max(found, key=lambda c: c.number).name

    def publish(self, build_id: str, tables: DataFrame | dict[str, DataFrame]) -> None:
        """Reserve, write, read back and activate: one table, or several by name. What fails marks the build as failed.

        A failed build's name may be used again; one that was left while importing (its writer died) by ``abandon``.
        """
        tables = tables if isinstance(tables, dict) else {"rows": tables}
        writer = uuid.uuid4().hex
        free = lambda log: (c := self._state(log).get(build_id)) is None or c.action == "failed"
        if not self.log.append(Commit("importing", build_id, writer), free):
            raise BuildError(f"build {build_id} exists")
        mine = lambda log: (c := self._state(log).get(build_id)) is not None and c.writer == writer and c.action == "importing"
        try:
            staged = self.log.staged(tables)
        except Exception:
            self.log.append(Commit("failed", build_id, writer), mine)
            raise
        if not self.log.append(Commit("verified", build_id, writer, staged), mine):
            self.log.drop(staged)
            raise BuildError(f"build {build_id} was abandoned while it was written")

    def abandon(self, build_id: str) -> None:
        """Mark a build that is still importing as failed; should its writer live, it can no longer activate it."""
        if not self.log.append(Commit("failed", build_id), lambda log: (c := self._state(log).get(build_id)) is not None and c.action == "importing"):
            raise BuildError(f"build {build_id} is not importing")

    def only(self) -> str:
        """The one verified build; none or several are an error."""
        found = [c.name for c in self._state(self.log.commits()).values() if c.action == "verified"]
        if len(found) != 1:
            raise BuildError(f"{len(found) or 'no'} verified builds where one was expected")
        return found[0]

    def read(self, build_id: str | None = None, table: str = "rows") -> DataFrame:
        """A table of a verified build, of the active one by default."""
        found = self._state(self.log.commits()).get(build_id or self.active())
        if found is None or found.action != "verified" or table not in found.tables:
            raise BuildError(f"no verified table {table} of build {build_id}")
        return self.log.read(found.tables[table])
