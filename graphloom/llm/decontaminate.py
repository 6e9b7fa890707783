"""Benchmark decontamination by Wu-Manber search over words.

A text's words are the search's symbols. For every window length, a shift table tells from the block of
two words at a position how far no window can end; where the shift is 0, the block's hash selects a
bucket of windows, and the words themselves are compared. Many positions are advanced side by side.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Chunk, free_name, map_texts, saved
from .textkit import ALNUM, LOWER, U, mix, span_hashes, word_spans

#: Words of a window, and bytes of benchmark text that one compiled search may hold.
WINDOW, SHARD_BYTES = 10, 16 << 20
_LANE = 128
_A, _B = U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)


class Words:
    """The alphanumeric words of some texts, lower-cased, each with one space behind it in ``joined``."""

    def __init__(self, chunk: Chunk):
        lowered = LOWER[chunk.data]
        starts, ends, self.first = word_spans(lowered, chunk.offsets, ALNUM)
        self.hashes = span_hashes(lowered, starts, ends)
        length = ends - starts
        self.at = np.concatenate([[0], np.cumsum(length + 1)])
        inside = lowered[ALNUM[lowered]]
        joined = np.full(self.at[-1], 0x20, np.uint8)
        joined[np.arange(len(inside)) + np.repeat(np.arange(len(starts)), length)] = inside
        self.joined = joined.tobytes()

    def run(self, begin: int, n: int) -> bytes:
        return self.joined[self.at[begin] : self.at[begin + n] - 1]


class Search:
    """Shift table and buckets for windows of one length: numbers of first words in ``words``, no window twice."""

    def __init__(self, m: int, words: Words, first: np.ndarray, items: np.ndarray):
        """first: first words of the windows; items: number of the item that each window is of."""
        self.m, self.block, self.words = m, min(2, m), words
        whole = np.zeros(len(first), U)
        for j in range(m):
            whole = mix(whole * _A + words.hashes[first + j])
        order = np.lexsort((items, whole))
        first, items, whole = first[order], items[order], whole[order]
        new = np.append(True, whole[1:] != whole[:-1])
        for i in np.flatnonzero(~new):  # equal hashes: one window if the words are equal too
            new[i] = words.run(first[i], m) != words.run(first[i - 1], m)
        owner = np.cumsum(new) - 1
        first = first[new]
        pairs = np.unique(np.stack([owner, items], axis=1), axis=0)
        self.owners, self.items = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)), pairs[:, 1].astype(np.uint32)
        self.bits = min(26, max(12, int(len(first) * m).bit_length() + 2))
        self.shift = np.full(1 << self.bits, m - self.block + 1, np.uint8)
        h = words.hashes
        for j in range(self.block - 1, m):
            np.minimum.at(self.shift, self._blocks(h[first + j - 1] if self.block > 1 else None, h[first + j]) >> U(64 - self.bits), np.uint8(m - 1 - j))
        last = self._blocks(h[first + m - 2] if self.block > 1 else None, h[first + m - 1])
        order = np.argsort(last, kind="stable")
        self.suffix, self.pattern, self.first = last[order], order, first

    def owned(self, k: int) -> np.ndarray:
        return self.items[self.owners[k] : self.owners[k + 1]]

    @staticmethod
    def _blocks(before, at):
        return mix(at * _B if before is None else before * _A + at * _B)

    def find(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last word and window number of every place where a window's word hashes stand."""
        lengths = np.diff(first) - (self.m - 1)
        lanes = np.maximum(0, -(-lengths // _LANE))
        row = np.repeat(np.arange(len(lengths)), lanes)
        within = np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = first[:-1][row] + self.m - 1 + within * _LANE
        stop = np.minimum(at + _LANE, first[1:][row])
        found = []
        while len(at):
            step = self.shift[self._blocks(words[at - 1] if self.block > 1 else None, words[at]) >> U(64 - self.bits)]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            alive = at < stop
            at, stop = at[alive], stop[alive]
        ends = np.concatenate(found) if found else np.zeros(0, np.int64)
        blocks = self._blocks(words[ends - 1] if self.block > 1 else None, words[ends])
        lo, hi = np.searchsorted(self.suffix, blocks, "left"), np.searchsorted(self.suffix, blocks, "right")
        size = hi - lo
        ends = np.repeat(ends, size)
        entry = np.repeat(lo, size) + np.arange(len(ends)) - np.repeat(np.cumsum(size) - size, size)
        same = np.ones(len(ends), bool)
        for j in range(self.m):
            same &= words[ends - self.m + 1 + j] == self.words.hashes[self.first[self.pattern[entry]] + j]
        return ends[same], self.pattern[entry[same]]


class Compiled:
    """The searches of some items, one for each window length. About 60 bytes for each word of theirs."""

    def __init__(self, items: list[tuple[str, str]], window: int):
        self.names = sorted({item for item, _ in items})
        number = {item: i for i, item in enumerate(self.names)}
        words = Words(Chunk(pa.array([t for _, t in items], pa.string())))
        size = np.diff(words.first)
        length = np.minimum(size, window)
        self.searches = []
        for m in np.unique(length[length > 0]).tolist():
            mine = np.flatnonzero(length == m)
            n = size[mine] - m + 1
            first = np.repeat(words.first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self.searches.append(Search(m, words, first, np.repeat(np.array([number[items[i][0]] for i in mine]), n)))


def _scan(compiled: Compiled):
    def step(chunk, rows):
        words = Words(chunk)
        first, depth = words.first, np.zeros(len(words.hashes) + 1, np.int64)
        items: dict[int, set[int]] = defaultdict(set)
        for search in compiled.searches:
            for end, k in zip(*search.find(words.hashes, first)):
                begin = end - search.m + 1
                if words.run(begin, search.m) == search.words.run(search.first[k], search.m):
                    depth[begin] += 1
                    depth[end + 1] -= 1
                    items[int(np.searchsorted(first, begin, "right")) - 1].update(search.owned(k).tolist())
        covered = np.flatnonzero(np.cumsum(depth[:-1]) > 0)
        at = np.searchsorted(covered, first)
        hits = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(covered - np.repeat(first[:-1], np.diff(at))))
        return {"n_words": np.diff(first), "hit_words": hits, "items": pa.array([[compiled.names[x] for x in sorted(items[i])] if i in items else [] for i in range(len(chunk))], pa.list_(pa.string()))}

    return step


def contaminated_words(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: list[str] | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs' columns ``keep`` (all by default) with n_words, hit_words and items.

    hit_words: positions of the words inside any occurrence of a benchmark window, ascending; items: ids
    (as strings, sorted) whose windows occur. Null or wordless texts have 0 words and no hits; items
    without words give no window; an item without id counts as ''. Repeated rows are scanned each on
    their own; a kept column of a new one's name, letter case aside, is replaced, all others are kept under
    any name. A compiled search is broadcast and holds at most about shard_bytes of benchmark text
    (or one item), some ten times that in memory; a larger benchmark is searched in shards, one after the
    other, whose hits are merged row by row: the columns and rows are the same for any number of shards.
    """
    spark = docs.sparkSession
    bench = benchmark.select(F.coalesce(F.col(f"`{item_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text")).where("text IS NOT NULL").distinct()
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    schema = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("hit_words", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in schema.names]
    row = F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(None).cast("int").alias(free_name(docs, "none"))).alias("row")
    packed = docs.select(row, F.col(f"`{text_col}`").cast("string").alias("text"))
    out = [*[F.col(f"row.`{c}`").alias(c) for c in kept], *schema.names]

    def scanned(rows, shard, keep):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == shard)
        shared = spark.sparkContext.broadcast(Compiled(sorted((r.item, r.text) for r in part.collect()), window))  # shard_bytes of text
        return map_texts(rows, "text", lambda: _scan(shared.value), schema, keep), shared

    if shards == 1:
        return scanned(packed, 0, ["row"])[0].select(*out)
    tagged = saved(packed.withColumn("id", F.monotonically_increasing_id()))
    sizes = hits = None
    for shard in range(shards):
        part, shared = scanned(tagged, shard, ["id"])
        if sizes is None:
            part = sizes = saved(part)
        else:
            part = saved(part.where(F.size("hit_words") > 0))
        found = part.where(F.size("hit_words") > 0).select("id", "hit_words", "items")
        hits = found if hits is None else hits.union(found)
        shared.destroy()
    once = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    merged = hits.groupBy("id").agg(*[once(c).alias(c) for c in ("hit_words", "items")])
    all_rows = tagged.select("id", "row").join(sizes.select("id", "n_words"), "id").join(merged, "id", "left")
    none = [F.coalesce(F.col(c), F.array().cast(schema[c].dataType)).alias(c) for c in ("hit_words", "items")]
    return all_rows.select("row", "n_words", *none).select(*out)
