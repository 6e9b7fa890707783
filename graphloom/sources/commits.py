"""A log of numbered commits: tables become visible together, and of two writers of one number one wins.

A commit is a small JSON file <path>/_log/<number>.json that can be created only once; the tables that it names lie
in folders of their own, which nothing ever changes. A writer puts its commit behind the newest one that it
knows; where another was faster, it looks at what that one did and tries the next number, or gives up.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import content_hash, content_sums

COMMIT = "number long, action string, name string, writer string, at double, tables map<string, struct<folder string, n_rows long, content_hash string, `schema` string>>"


class BuildError(RuntimeError):
    """A build, batch or snapshot that may not be written."""


class NotPublished(BuildError, LookupError):
    """Nothing of that name was published."""


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file with its whole text; False, and nothing changed, where it exists. Of several callers one gets True.

    The text is written beside it first. On a local file system the name is made by a hard link, on others by the
    file system's rename that never replaces (atomic in HDFS and in stores with conditional renames).
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(path)
    fs = final.getFileSystem(conf)
    final = fs.makeQualified(final)
    beside = jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{final.getName()}.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if final.toUri().getScheme() == "file":
            file = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(file(final), file(beside))
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), conf).rename(beside, final, none)
        return True
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(beside, False)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names of a folder's files; none where it does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []


def read_text(spark: SparkSession, path: str) -> str:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


@dataclass
class Commit:
    """What one number of the log says; tables: for each name its folder, number of rows, content hash and schema."""

    action: str
    name: str
    writer: str = ""
    tables: dict[str, dict] = field(default_factory=dict)
    number: int = -1
    at: float = 0.0

    def content(self) -> dict[str, tuple]:
        """What makes two commits' tables equal, wherever they lie."""
        return {k: (t["n_rows"], t["content_hash"], t["schema"]) for k, t in self.tables.items()}


class CommitLog:
    """The log under a path. Commits are read once each; a commit never changes."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._known: dict[int, Commit] = {}

    def _file(self, number: int) -> str:
        return f"{self.path}/_log/{number:012d}.json"

    def commits(self) -> list[Commit]:
        """All commits by number. They are one small file for each transaction, not for each row."""
        for name in names(self.spark, f"{self.path}/_log"):
            if name.endswith(".json") and not name.startswith((".", "_")) and (number := int(name[:-5])) not in self._known:
                self._known[number] = Commit(**json.loads(read_text(self.spark, self._file(number))))
        return [self._known[k] for k in sorted(self._known)]

    def table(self) -> DataFrame:
        """The log as a table."""
        rows = self.commits()
        return self.spark.createDataFrame([(c.number, c.action, c.name, c.writer, c.at, {k: (t["folder"], t["n_rows"], t["content_hash"], t["schema"]) for k, t in c.tables.items()}) for c in rows], COMMIT)

    def append(self, commit: Commit, allowed: Callable[[list[Commit]], bool] = lambda log: True) -> bool:
        """Put a commit behind all others; False once the log, as it then stands, does not allow it.

        ``allowed`` sees every commit that comes before this one, so what it decides still holds when it is written.
        """
        while True:
            log = self.commits()
            if not allowed(log):
                return False
            commit.number, commit.at = (log[-1].number + 1 if log else 0), time.time()
            if put_if_absent(self.spark, self._file(commit.number), json.dumps(asdict(commit))):
                return True

    def staged(self, tables: dict[str, DataFrame]) -> dict[str, dict]:
        """Write tables into new folders, and read each back: what is read must be what was written."""
        out = {}
        for name, df in tables.items():
            folder, columns = f"data/{uuid.uuid4().hex}/{name}", sorted(df.columns)
            written = Observation()  # of the rows that are written, not of another evaluation
            df.observe(written, *content_sums(columns)).write.parquet(f"{self.path}/{folder}")
            back = content_hash(self.spark.read.schema(df.schema).parquet(f"{self.path}/{folder}"), columns).first()
            if back.asDict() != written.get:
                raise BuildError(f"{name} reads back differently")
            out[name] = {"folder": folder, "n_rows": back.n_rows, "content_hash": back.content_hash, "schema": df.schema.json()}
        return out

    def drop(self, tables: dict[str, dict]) -> None:
        """Delete staged tables that no commit names."""
        named = {t["folder"] for c in self.commits() for t in c.tables.values()}
        for t in tables.values():
            if t["folder"] not in named:
                place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{t['folder']}").getParent()
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def read(self, table: dict) -> DataFrame:
        from pyspark.sql.types import StructType

        return self.spark.read.schema(StructType.fromJson(json.loads(table["schema"]))).parquet(f"{self.path}/{table['folder']}")

    def publish_batch(self, run_id: str, batch: int, tables: dict[str, DataFrame]) -> bool:
        """Publish a batch's tables once: True if it is new, False if this very payload was published before.

        The same batch with another payload is an error, whoever comes first; what was published stays.
        """
        name = f"{run_id}/{batch}"
        staged = self.staged(tables)
        commit = Commit("batch", name, tables=staged)
        before = lambda log: next((c for c in log if c.action == "batch" and c.name == name), None)
        if self.append(commit, lambda log: before(log) is None):
            return True
        first = before(self.commits())
        self.drop(staged)
        if first.content() != commit.content():
            raise BuildError(f"batch {batch} of {run_id} comes again with another payload")
        return False

    def batches(self, table: str, run_id: str | None = None) -> DataFrame:
        """All rows of a table of the published batches, with the batch's number; the folders are those that commits name."""
        found = [(c, c.tables[table]) for c in self.commits() if c.action == "batch" and table in c.tables and (run_id is None or c.name.rpartition("/")[0] == run_id)]
        if not found:
            raise NotPublished(f"no batch of {table}")
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(found[0][1]["schema"]))
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{t['folder']}" for _, t in found])
        number = self.spark.createDataFrame([(t["folder"].split("/")[1], int(c.name.rpartition("/")[2])) for c, t in found], "__folder string, batch long")
        return rows.withColumn("__folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -3)).join(F.broadcast(number), "__folder").drop("__folder")  # a row for each commit

    def replace_all(self, name: str, tables: dict[str, DataFrame], base: int | None = None) -> int:
        """Publish tables as the new snapshot, all or none, and return its number.

        With ``base`` only if no snapshot came after that number: a writer that worked on an older state is refused.
        """
        staged = self.staged(tables)
        commit = Commit("snapshot", name, tables=staged)
        newest = lambda log: max((c.number for c in log if c.action == "snapshot"), default=-1)
        if not self.append(commit, lambda log: base is None or newest(log) <= base):
            self.drop(staged)
            raise BuildError(f"another snapshot came after number {base}")
        return commit.number

    def snapshot(self, number: int | None = None) -> dict[str, DataFrame]:
        """The tables of the newest snapshot, or of the newest up to a number: always of one commit."""
        found = [c for c in self.commits() if c.action == "snapshot" and (number is None or c.number <= number)]
        if not found:
            raise NotPublished("no snapshot")
        return {k: self.read(t) for k, t in found[-1].tables.items()}
