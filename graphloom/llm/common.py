"""Shared plumbing of the text operators: tables in the shared folder, Arrow batches cut by bytes."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import shared_folder, ship_package

#: Bytes of text that one vectorised step works on; a longer document is a step of its own.
CHUNK_BYTES = 1 << 19
WORDS_JAVA = r"[^\x20\x09-\x0D]+"


_scratch: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Tables saved inside are deleted at the end, unless they were saved with ``keep``."""
    paths: list[str] = []
    token = _scratch.set(paths)
    try:
        yield
    finally:
        _scratch.reset(token)
        for path in paths:
            drop_folder(spark, path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote, through the file system that it lies in."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def saved(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and return the written table: lineage ends here."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    if not keep and (paths := _scratch.get()) is not None:
        paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def split_join(rows: DataFrame, per_key: DataFrame, key: str | list[str], count: str, parts: int = 512) -> DataFrame:
    """rows joined with a table of one row for each key, of which ``count`` tells how many rows have it.

    Keys of more than one row in ``parts`` (so fewer than ``parts`` keys) are broadcast and their rows stay
    where they are; the rows of all other keys are dealt by key. per_key is read thrice: give a saved table.
    """
    total = per_key.agg(F.sum(count)).first()[0] or 0
    hot = F.broadcast(per_key.where(F.col(count) * parts > total))
    keys = [key] if isinstance(key, str) else key
    rest = rows.join(hot.select(*keys), key, "left_anti").join(per_key.where(F.col(count) * parts <= total), key)
    return rows.join(hot, key).unionByName(rest)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


class Chunk:
    """Some consecutive rows' texts: one byte array, and where each row begins and ends in it."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
        buffer = texts.buffers()[2]
        all_bytes = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        self.data = all_bytes[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.texts = texts

    def __len__(self) -> int:
        return len(self.offsets) - 1


def chunks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about CHUNK_BYTES of text each; every row is in exactly one."""
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + CHUNK_BYTES, "right")))
        yield at, stop
        at = stop


def map_texts(
    df: DataFrame,
    text_col: str,
    make: Callable[[], Callable[[Chunk, pa.RecordBatch], dict[str, object]]],
    new: T.StructType,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add columns computed from whole texts to the columns ``keep`` (all by default).

    ``make()`` runs once in each task and returns the function that maps a chunk and its rows to the
    new columns. A new column replaces a kept one of the same name (letter case aside, as Spark compares).
    """
    ship_package(df.sparkSession)
    made_names = {n.lower() for n in new.names}
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in made_names]
    kept = df.select(*[F.col(f"`{c}`") for c in keep])
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias(free_name(df, "text")))
    schema = T.StructType([*[T.StructField(f.name, f.dataType, True) for f in kept.schema.fields], *new.fields])
    arrow_new = pa.schema([pa.field(f.name, _arrow(f.dataType)) for f in new.fields])
    n = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            texts = batch.column(n)
            for lo, hi in chunks(texts):
                rows = batch.slice(lo, hi - lo)
                made = step(Chunk(rows.column(n)), rows)
                columns = [pa.array(made[f.name], type=f.type, from_pandas=False) if not isinstance(made[f.name], pa.Array) else made[f.name].cast(f.type) for f in arrow_new]
                yield pa.RecordBatch.from_arrays([*rows.columns[:n], *columns], names=schema.names)

    return source.mapInArrow(run, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
