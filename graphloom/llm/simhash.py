"""Near-duplicate groups by SimHash fingerprints, linked through a grid of segment bit counts.

A fingerprint of 64 bits is cut into segments of WIDTHS[0] bits, and the numbers of bits set in them are a
point of integers. Two points lie no further apart (sum of absolute differences) than the fingerprints have
differing bits, so fingerprints of at most two differing bits have points that are equal, neighbours, or have
a neighbour in common. Every fingerprint is dealt to the grid cell of its point and to all neighbouring cells;
those that meet in a cell are compared bit by bit. A cell of more than CELL fingerprints is not compared: its
fingerprints are dealt again with segments of half the width. In segments of one bit a cell holds at most 65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Chunk, map_texts, saved, scratch, ship_package, split_join
from .near_dedup import components
from .textkit import LOWER, WORD, U, word_spans

WIDTHS, CELL, SEED, BITS = (4, 2, 1), 128, 42, 2
#: Shingles whose bits are counted at once, and fingerprints that one step of a task deals or compares.
BLOCK, STEP = 1 << 16, 1 << 15
_ONES = {1: 0x5555555555555555, 2: 0x3333333333333333}


def shingle_hashes(chunk: Chunk, size: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every shingle of every text, repeats included, and where each text's begin (one more at the end)."""
    lowered = LOWER[chunk.data]
    starts, ends, first = word_spans(lowered, chunk.offsets)
    length = ends - starts
    at = np.concatenate([[0], np.cumsum(length + 1)])
    joined = np.full(at[-1], 0x20, np.uint8)  # every word with one space behind it
    joined[np.arange(len(lowered[WORD[lowered]])) + np.repeat(np.arange(len(starts)), length)] = lowered[WORD[lowered]]
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(n_words - size + 1, 1), 0)
    border = np.concatenate([[0], np.cumsum(n)])
    word = np.repeat(first[:-1] - border[:-1], n) + np.arange(border[-1])
    last = np.minimum(word + size, np.repeat(first[1:], n))
    raw, digest = joined.tobytes(), xxhash.xxh64_intdigest
    return np.fromiter((digest(raw[a:b], SEED) for a, b in zip(at[word].tolist(), (at[last] - 1).tolist())), U, len(word)), border


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit what over half of the hashes have; 0 without any."""
    count = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), BLOCK):
        part = hashes[lo : lo + BLOCK].astype("<u8")
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(size: int):
    def step(chunk, rows):
        hashes, border = shingle_hashes(chunk, size)
        prints = np.array([fingerprint(hashes[a:b]) for a, b in zip(border[:-1], border[1:])], U)
        return {"n_shingles": np.diff(border), "print": prints.view(np.int64)}

    return step


def points(prints: np.ndarray, width: int) -> np.ndarray:
    """Numbers of set bits of the segments, each in as many bits as the segment has."""
    x, w = prints, 1
    while w < width:
        x = (x & U(_ONES[w])) + ((x >> U(w)) & U(_ONES[w]))
        w *= 2
    return x


def cells(prints: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, number of the fingerprint): each one's own cell and those where one count is one more or one less."""
    own = points(prints, width)
    found, who = [own], [np.arange(len(own))]
    for segment in range(0, 64, width):
        count = (own >> U(segment)) & U((1 << width) - 1)
        for may, step in ((count < width, own + U(1 << segment)), (count > 0, own - U(1 << segment))):
            found.append(step[may])
            who.append(np.flatnonzero(may))
    return np.concatenate(found), np.concatenate(who)


def _dealt(prints: DataFrame, width: int) -> DataFrame:
    """(cell, print) for every cell that a fingerprint is dealt to."""

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), STEP):
                own = batch.column(0).slice(lo, STEP).to_numpy().view(U)
                cell, who = cells(own, width)
                yield pa.RecordBatch.from_arrays([pa.array(cell.view(np.int64)), pa.array(own[who].view(np.int64))], names=["cell", "print"])

    ship_package(prints.sparkSession)
    return prints.select("print").mapInArrow(run, "cell long, print long")


def spanning(group: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows by group: pairs that join what differs in at most ``bits`` bits inside a group, one pair less than rows joined."""
    n = len(prints)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, apart = np.arange(n - 1), 1
    while len(at := at[at + apart < n]):
        at = at[group[at] == group[at + apart]]  # who has no neighbour this far has none further
        near = at[np.bitwise_count(prints[at] ^ prints[at + apart]) <= bits]
        a.append(near)
        b.append(near + apart)
        apart += 1
    a, b = np.concatenate(a), np.concatenate(b)
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    joined = np.flatnonzero(label != np.arange(n))
    return prints[label[joined]], prints[joined]


def _compared(rows: DataFrame, bits: int) -> DataFrame:
    """(a, b): links that join the fingerprints of each cell as all its links would."""

    def run(batches):
        held = None
        for batch in (*batches, None):
            if batch is not None:
                table = pa.Table.from_batches([batch])
                held = table if held is None else pa.concat_tables([held, table])
            if held is None or (batch is not None and len(held) < STEP):
                continue
            cell = held.column(0).to_numpy()
            cut = int(np.searchsorted(cell, cell[-1])) if batch is not None else len(cell)
            a, b = spanning(cell[:cut], held.column(1).to_numpy()[:cut].view(U), bits)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
            held = held.slice(cut) if cut < len(cell) else None

    return rows.select("cell", "print").repartition("cell").sortWithinPartitions("cell", "print").mapInArrow(run, "a long, b long")


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """(a, b): links between the different fingerprints of ``prints`` that join what differs in at most ``bits`` bits.

    Each width deals a fixed number of rows for each fingerprint; cells of one are dropped, cells of at most
    CELL compared, the fingerprints of all others go to the next width, where each meets all that it is near to.
    """
    if not 0 <= bits <= 2:
        raise ValueError("neighbouring cells prove what differs in at most two bits")
    found, left = None, prints.select("print")
    for width in WIDTHS:
        dealt = _dealt(left, width)
        held = saved(dealt.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1"))
        met = saved(split_join(dealt, held, "cell", "n"))
        full = F.col("n") > CELL if width > 1 else F.lit(False)
        part = _compared(met.where(~full), bits)
        found = part if found is None else found.union(part)
        left = saved(met.where(full).select("print").distinct())
        if left.isEmpty():
            break
    return found.distinct()


def near_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, bits: int = BITS) -> DataFrame:
    """A row for each row of docs: id, n_shingles, print (the fingerprint as a signed long), component_id.

    A fingerprint's bit is set where over half of the text's shingles (of ``size`` words, repeats included) have
    it in their XXH64 hash. Fingerprints that differ in at most ``bits`` bits are linked; component_id is the
    smallest id that links reach, null where no row of the group has an id. Texts without words (null ones too)
    have the fingerprint 0, which is linked like any other; a text of fewer words is one shingle. Repeated rows
    have equal fingerprints; rows without id belong to groups as others do; empty docs give no rows; other
    columns are not read. The result is a table in the shared folder; all other tables of the work are deleted.
    """
    with scratch(docs.sparkSession):
        source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
        schema = T.StructType([T.StructField("n_shingles", T.LongType()), T.StructField("print", T.LongType())])
        rows = saved(map_texts(source, "text", lambda: _fingerprints(size), schema, ["id"]))
        prints = saved(rows.groupBy("print").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")))
        roots = components(links(prints, bits)).withColumnRenamed("node", "print")
        grouped = saved(prints.join(roots, "print", "left").withColumn("root", F.coalesce("root", "print")))
        named = saved(grouped.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n")))
        named = saved(split_join(grouped, named, "root", "n").select("print", "component_id", "copies"))
        out = split_join(rows, named, "print", "copies")
        return saved(out.select(F.col("id").alias(id_col), "n_shingles", "print", "component_id"), keep=True)
