"""Many patterns in many texts without hot keys: rare anchors for passages, an automaton for short ones and for names.

Patterns go out in shards of bounded size, texts stay where they are: no word of a text is dealt anywhere, however
frequent it is, and nothing is compared that does not share a rare word or a piece of an automaton.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text
from ..runtime import ship_package

#: Bytes of patterns that go out together; an automaton takes some fifty times that in each worker.
SHARD_BYTES = 2 << 20
#: Ids of passages that go out together, those that meet rows at once, and rows that leave a task at once.
ROWS, BLOCK, PAIRS = 1 << 22, 1 << 12, 1 << 16


def shards(patterns: DataFrame, pattern_col: str, shard_bytes: int = SHARD_BYTES) -> Iterator[DataFrame]:
    """The patterns in parts of about shard_bytes each, by hash."""
    total = patterns.agg(F.sum(F.octet_length(pattern_col))).first()[0] or 0
    n = max(1, -(-total // shard_bytes))
    for i in range(n):
        yield patterns.where(F.pmod(F.xxhash64(pattern_col), F.lit(n)) == i) if n > 1 else patterns


def automaton(patterns: list[str]) -> ahocorasick.Automaton | None:
    """Finds every occurrence of every pattern, as (end, pattern)."""
    made = ahocorasick.Automaton()
    for p in patterns:
        made.add_word(p, p)
    if not len(made):
        return None
    made.make_automaton()
    return made


def _inner(passage: str) -> list[str]:
    """The words of a passage that stand whole in a text that contains it: all but the first and the last."""
    return passage.split(" ")[1:-1]


def word_frequencies(texts: DataFrame, text_col: str, wanted: set[str]) -> dict[str, int]:
    """How many texts hold each of some words; a row for each of these words reaches the driver."""
    shared = texts.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        counts: dict[str, int] = defaultdict(int)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for w in shared.value & set((t or "").split(" ")):
                    counts[w] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    ship_package(texts.sparkSession)
    rows = texts.select(text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in rows.collect()}


def _found(texts: DataFrame, id_col: str, columns: list[str], schema: T.StructType, make: Callable) -> DataFrame:
    """Rows (id, pattern id, ...) of what ``make()`` finds in the columns of each text."""
    arrow = to_arrow_schema(schema)

    def run(batches):
        look = make()
        for batch in batches:
            rows, found = [], []
            for i, values in enumerate(zip(*[batch.column(1 + k).to_pylist() for k in range(len(columns))])):
                for hit in look(*values):
                    rows.append(i)
                    found.append(hit)
            if rows:
                more = [pa.array([h[k] for h in found], type=f.type) for k, f in enumerate(list(arrow)[1:])]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *more], names=schema.names)

    ship_package(texts.sparkSession)
    return texts.select(id_col, *columns).mapInArrow(run, schema)


def _of_rows(patterns: DataFrame, most: int) -> Iterator[DataFrame]:
    """The patterns in parts of about so many rows, by hash of all columns: equal patterns may go to several."""
    n = max(1, -(-patterns.count() // most))
    for i in range(n):
        yield patterns.where(F.pmod(F.xxhash64(*patterns.columns), F.lit(n)) == i) if n > 1 else patterns


def _by_pattern(table: pa.Table) -> tuple[dict[str, tuple[int, int]], pa.Array]:
    """Where each pattern's ids stand, and all ids, of (pattern, id)."""
    names = table.column(0).combine_chunks().dictionary_encode()
    code = names.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    ends = np.cumsum(np.bincount(code, minlength=len(names.dictionary)))
    return {p: (int(b - n), int(b)) for p, b, n in zip(names.dictionary.to_pylist(), ends, np.diff(ends, prepend=0))}, table.column(1).combine_chunks().take(pa.array(order))


def _pairs(found: dict[str, list[int]], places: dict[str, tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row with each id of the patterns found in it, as places, some PAIRS at a time.

    The ids of one pattern come in blocks, each with all its rows: neighbours share their values, which files store well.
    """
    held, n = [], 0
    for p, rows in found.items():
        rows, (lo, hi) = np.array(rows), places[p]
        for begin in range(lo, hi, BLOCK):
            ids = np.arange(begin, min(begin + BLOCK, hi))
            step = max(1, PAIRS // len(ids))
            for at in range(0, len(rows), step):
                some = rows[at : at + step]
                held.append((np.repeat(some, len(ids)), np.tile(ids, len(some))))
                n += len(some) * len(ids)
                if n >= PAIRS:
                    yield tuple(map(np.concatenate, zip(*held)))
                    held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def contained(passages: DataFrame, passage_id: str, passage_col: str, texts: DataFrame, text_id: str, text_col: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(passage id, text id) where a text contains a passage, both in lower case with single blanks; words may be cut at a passage's ends.

    A passage of three words or more is looked for in the texts that hold the one of its inner words that fewest
    texts hold, which is measured; shorter ones by an automaton. Null texts and passages contain nothing and are
    contained in nothing; an empty passage is contained in every text. Repeated rows give a row each: texts are searched
    for distinct passages, and what is found meets the ids of a passage in parts of bounded size.
    """
    squeezed = lambda df, i, c: df.select(F.col(i), text.squeeze(F.lower(F.col(c))).alias("__t")).where("__t IS NOT NULL")
    patterns, rows = squeezed(passages, passage_id, passage_col), squeezed(texts, text_id, text_col)
    schema = T.StructType([T.StructField(text_id, rows.schema[text_id].dataType), T.StructField(passage_id, patterns.schema[passage_id].dataType)])
    parts = []
    for shard in (part for whole in shards(patterns, "__t", shard_bytes) for part in _of_rows(whole, ROWS)):
        held, ids = _by_pattern(shard.select("__t", passage_id).toArrow())  # shard_bytes of passages, ROWS ids
        often = word_frequencies(rows, "__t", {w for p in held for w in _inner(p)}) if any(map(_inner, held)) else {}
        anchors: dict[str, list[str]] = defaultdict(list)
        for p in held:
            words = _inner(p)
            if words and all(w in often for w in words):  # else no text holds them all
                anchors[min(words, key=lambda w: (often[w], w))].append(p)
        shared = texts.sparkSession.sparkContext.broadcast((held, ids, dict(anchors), [p for p in held if p and not _inner(p)]))

        def run(batches, shared=shared):
            places, numbers, by_word, short = shared.value
            machine = automaton(short)

            def look(t: str):
                yield from (p for w in by_word.keys() & set(t.split(" ")) for p in by_word[w] if p in t)
                if machine is not None:
                    yield from {p for _, p in machine.iter(t)}
                if "" in places:
                    yield ""

            for batch in batches:
                found: dict[str, list[int]] = defaultdict(list)
                for i, t in enumerate(batch.column(1).to_pylist()):
                    for p in look(t):
                        found[p].append(i)
                for at, of in _pairs(found, places):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), numbers.take(pa.array(of))], names=schema.names)

        ship_package(texts.sparkSession)
        parts.append(rows.mapInArrow(run, schema))
    return reduce(DataFrame.union, parts).select(passage_id, text_id)


def named(names: DataFrame, name_col: str, keys: list[str], texts: DataFrame, id_col: str, whole: Column, anywhere: Column, is_free: Column, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(id, *keys) where a text names a name: as whole words of ``whole``, or where is_free(names) also inside of ``anywhere``.

    whole: the text as words with single blanks; names without any letter of a word are found nowhere but free ones.
    """
    rows = texts.select(F.col(id_col), F.concat(F.lit(" "), whole, F.lit(" ")).alias("__w"), anywhere.alias("__t")).where("__w IS NOT NULL AND __t IS NOT NULL")
    listed = names.select(F.col(name_col).alias("__n"), is_free.alias("__free"), *keys).where("__n IS NOT NULL")
    schema = T.StructType([T.StructField(id_col, rows.schema[id_col].dataType), *[T.StructField(k, listed.schema[k].dataType) for k in keys]])
    parts = []
    for shard in shards(listed, "__n", shard_bytes):
        whole_words: dict[str, list] = defaultdict(list)
        free: dict[str, list] = defaultdict(list)
        for r in shard.collect():  # shard_bytes of names
            value = tuple(r[k] for k in keys)
            whole_words[f" {r['__n']} "].append(value)
            if r["__free"]:
                free[r["__n"]].append(value)
        shared = texts.sparkSession.sparkContext.broadcast((dict(whole_words), dict(free)))

        def make(shared=shared):
            tables = shared.value
            machines = [automaton(list(t)) for t in tables]

            def look(words: str, plain: str):
                hits = set()
                for machine, table, t in zip(machines, tables, (words, plain)):
                    if machine is not None:
                        hits.update(value for p in {p for _, p in machine.iter(t)} for value in table[p])
                return hits

            return look

        parts.append(_found(rows, id_col, ["__w", "__t"], schema, make))
    return reduce(DataFrame.union, parts)
