"""Incremental work: items with a state each, retries of single items, and results published once by batch."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState

from ..runtime import ship_package
from ..sources.commits import CommitLog, put_if_absent, read_text

#: What a queue publishes of an attempt. status: verified, failed (it will be tried again), parked (it will not)
#: or refused (an item that is known came with another payload; its state stays).
ATTEMPT = "id string, status string, attempts int, error string, result string"
STATE = "status string, attempts int, signature string, payload string"


class SignatureError(RuntimeError):
    """A run id comes back with other inputs."""


def guarded(spark: SparkSession, path: str, run_id: str, signature: str) -> None:
    """Remember a run's signature; the same id with another one is an error. Of several first callers one decides."""
    file = f"{path.rstrip('/')}/_runs/{hashlib.sha256(run_id.encode()).hexdigest()}"
    if not put_if_absent(spark, file, signature) and read_text(spark, file) != signature:
        raise SignatureError(run_id)


def process_stream(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, max_attempts: int = 3) -> StreamingQuery:
    """Run ``work`` over each micro-batch as a whole and publish its rows under the batch's number.

    A repeated batch overwrites its own folder, so results appear once; a failing batch is tried max_attempts times.
    Items that may fail one by one belong into an ItemQueue.
    """

    def each(batch: DataFrame, number: int) -> None:
        for attempt in range(1, max_attempts + 1):
            try:
                work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")
                return
            except Exception:
                if attempt == max_attempts:
                    raise

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _attempts(work: Callable[[str | None, int], str | None], max_attempts: int):
    """One group of the stateful operator: an item's new rows and retries against its state."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, attempts, signature, payload = state.get if state.exists else (None, 0, None, None)
        rows = []
        for frame in frames:
            for text, mark, retry in zip(frame["payload"], frame["signature"], frame["retry"]):
                text = None if pd.isna(text) else text
                if pd.isna(retry):
                    if status is not None:  # the item is known
                        if mark != signature:
                            rows.append((key[0], "refused", attempts, "SignatureError", None))
                        continue
                    signature, payload = mark, text
                elif status != "failed" or int(retry) != attempts:
                    continue  # a retry that was made already
                attempts += 1
                try:
                    result, status, error, payload_left = work(payload, attempts), "verified", None, None
                except Exception as failure:
                    result, status, error = None, "failed" if attempts < max_attempts else "parked", f"{type(failure).__name__}: {failure}"
                    payload_left = payload
                payload = payload_left
                rows.append((key[0], status, attempts, error, result))
        if status is not None:
            state.update((status, attempts, signature, payload))
        if rows:
            yield pd.DataFrame(rows, columns=["id", "status", "attempts", "error", "result"])

    return step


class ItemQueue:
    """A stream of items of which each is worked on alone, with a state of its own in the checkpoint.

    An item is new, failed, parked or verified, with its number of attempts. One that fails stays in the state with
    its payload and is the only one to be tried again; after max_attempts it is parked, and all others go on. Every
    attempt is a row that its micro-batch publishes through a commit log: a batch that is repeated after a crash
    must bring the same rows, else it is refused. The published failures are themselves a stream, joined to that of
    the items, which brings the retries; an item's state tells which of them are still to be made. ``work`` gets
    payload and attempt in a Python worker and returns a text, or raises; a repeated batch calls it again, so for equal
    arguments its results must be equal, or the crash between publishing and checkpoint shows as a refused batch.
    """

    def __init__(self, spark: SparkSession, path: str, work: Callable[[str | None, int], str | None], max_attempts: int = 3):
        self.spark, self.path, self.work, self.max_attempts = spark, path.rstrip("/"), work, max_attempts
        self.log = CommitLog(spark, f"{self.path}/published")
        for folder in ("published/data", "published/_log"):
            place = spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
            place.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(place)

    def _query(self, items: DataFrame, id_col: str, payload_col: str) -> DataFrame:
        ship_package(self.spark)
        payload = F.col(payload_col).cast("string")
        new = items.select(F.col(id_col).cast("string").alias("id"), payload.alias("payload"), F.sha2(F.coalesce(F.concat(F.lit("="), payload), F.lit("")).cast("binary"), 256).alias("signature"), F.lit(None).cast("int").alias("retry"))
        published = self.spark.readStream.schema(ATTEMPT).option("recursiveFileLookup", True).parquet(f"{self.path}/published/data")
        none = F.lit(None).cast("string")
        again = published.where("status = 'failed'").select("id", none.alias("payload"), none.alias("signature"), F.col("attempts").alias("retry"))
        step = _attempts(self.work, self.max_attempts)
        return new.union(again).groupBy("id").applyInPandasWithState(step, ATTEMPT, STATE, "update", "NoTimeout")

    def start(self, items: DataFrame, id_col: str = "id", payload_col: str = "payload", **trigger) -> StreamingQuery:
        """Run over a stream of items, until it is stopped or, by default, until what is there now was tried once."""
        publish = lambda rows, number: self.log.publish_batch("attempts", number, {"attempts": rows})
        writer = self._query(items, id_col, payload_col).writeStream.outputMode("update").foreachBatch(publish)
        return writer.option("checkpointLocation", f"{self.path}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()

    def drain(self, items: Callable[[], DataFrame], id_col: str = "id", payload_col: str = "payload") -> None:
        """Work on all that is there until every item is verified or parked: at most max_attempts passes, of which
        all but the first read only what failed. ``items`` makes the stream anew for each pass."""
        for _ in range(self.max_attempts + 1):
            self.start(items(), id_col, payload_col).awaitTermination()
            if self.status().where("status = 'failed'").isEmpty():
                return
        raise RuntimeError("items that failed were not tried again")

    def attempts(self) -> DataFrame:
        """All published attempts."""
        try:
            return self.log.batches("attempts")
        except LookupError:
            return self.spark.createDataFrame([], f"{ATTEMPT}, batch long")

    def status(self) -> DataFrame:
        """(id, status, attempts, error, result) of each item: its last attempt."""
        rows = self.attempts().where("status <> 'refused'")
        return rows.groupBy("id").agg(F.max_by(F.struct("status", "attempts", "error", "result"), "attempts").alias("x")).select("id", "x.*")

    def refused(self) -> DataFrame:
        """Ids of known items that came with another payload."""
        return self.attempts().where("status = 'refused'").select("id").distinct()

    def results(self) -> DataFrame:
        return self.status().where("status = 'verified'").select("id", "result")

    def state(self) -> DataFrame:
        """(id, status, attempts, signature) as the checkpoint holds it."""
        rows = self.spark.read.format("statestore").load(f"{self.path}/checkpoint")
        return rows.select(F.col("key.id").alias("id"), "value.groupState.status", "value.groupState.attempts", "value.groupState.signature")
