"""Language-model scores by context-tree weighting over bytes, beside an add-one word unigram.

Texts are lower-cased (A-Z) and closed by an end byte. A byte is eight binary decisions, each with a
context tree over the CONTEXT bytes before. Krichevsky-Trofimov estimates of all depths are mixed with
the weights of the tree's block probabilities, which follow from the counts alone. A gram is a byte with
its context, exact in one number; the counts of all grams stay distributed and grow with the corpus.
One pass for each depth, dealt by the next shorter context, folds block probabilities upwards, and
another hands the mixtures down to the grams.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Chunk, chunks, map_texts, saved, ship_package
from .textkit import LOWER, span_hashes, word_spans

CONTEXT, END, WORD, TEXTS = 5, 0xFF, 1, 2
#: Words and grams that are broadcast with their numbers (16 and 12 bytes each); rarer ones are joined.
FREQUENT_WORDS, FREQUENT_GRAMS = 1 << 19, 1 << 22
#: Rows that a step of the tree takes at once; a group under one context has at most 2^16 grams.
STEP = 1 << 16
#: Distinct keys that a counting task holds before it gives their sums out (24 bytes each, thrice while summing).
HELD = 1 << 21


def grams(data: np.ndarray, offsets: np.ndarray, context: int = CONTEXT) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of a chunk's texts (each with its end byte) with the bytes before it, and the texts' borders.

    The lowest eight bits are the byte, the next eight the byte before it, and so on; before a text stand end bytes.
    """
    n = len(offsets) - 1
    sizes, at = np.diff(offsets), offsets + np.arange(n + 1)
    padded = np.full(len(data) + n * (context + 1), END, np.uint8)
    padded[np.arange(len(data)) + np.repeat((np.arange(n) + 1) * context + np.arange(n), sizes)] = LOWER[data]
    keys = padded[context:].astype(np.int64)
    for j in range(1, context + 1):
        keys |= padded[context - j : len(padded) - j].astype(np.int64) << (8 * j)
    return keys[np.arange(at[-1]) + np.repeat(np.arange(n) * context, sizes + 1)], at


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x > 0: Stirling's series at x + 8, and the recurrence back."""
    y = x + 8.0
    product = x.copy()
    for k in range(1, 8):
        product *= x + k
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(product)


_HALF = math.log(0.5)


def _kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1) - math.log(math.pi)


def _decisions(keys: np.ndarray, n: np.ndarray):
    """For each of a byte's eight decisions: first row, row -> place, zeros and ones of the decisions of all contexts.

    Rows are grams, those of a context together and its bytes ascending.
    """
    context, byte = keys >> 8, keys & 255
    n = n.astype(float)
    for level in range(8):
        node = byte >> (8 - level)
        new = np.ones(len(keys), bool)
        new[1:] = (context[1:] != context[:-1]) | (node[1:] != node[:-1])
        first = np.flatnonzero(new)
        one = n * (byte >> (7 - level) & 1)
        ones = np.add.reduceat(one, first)
        yield level, first, np.cumsum(new) - 1, np.add.reduceat(n, first) - ones, ones


def _weights(zeros, ones, below):
    """KT block log probability and the weighted one, given the sum over the longer contexts (None at full depth)."""
    block = _kt_block(zeros, ones)
    return block, block if below is None else np.logaddexp(_HALF + block, _HALF + below)


def _folded(parent: np.ndarray, keys: np.ndarray, n: np.ndarray, below: np.ndarray | None):
    """Grams of the next shorter contexts: keys, counts, and for each decision the sum of log weights over the longer ones."""
    byte = keys & 255
    group = np.cumsum(np.append(True, parent[1:] != parent[:-1])) - 1
    shorter, inverse = np.unique(group << 8 | byte, return_inverse=True)
    sums = np.empty((len(shorter), 8))
    for level, first, _, zeros, ones in _decisions(keys, n):
        weight = _weights(zeros, ones, None if below is None else below[first, level])[1]
        place, at = np.unique((group[first] << level) | (byte[first] >> (8 - level)), return_inverse=True)
        sums[:, level] = np.bincount(at, weight)[np.searchsorted(place, (shorter >> 8 << level) | ((shorter & 255) >> (8 - level)))]
    context = parent[np.searchsorted(group, shorter >> 8)]
    return context << 8 | (shorter & 255), np.bincount(inverse, n).astype(np.int64), sums


def _mixed(keys: np.ndarray, n: np.ndarray, below: np.ndarray | None, given: np.ndarray, left: np.ndarray):
    """Probability of each decision of a gram mixed down to its depth, and the weight left to longer contexts."""
    byte = keys & 255
    given, left = given.copy(), left.copy()
    for level, first, place, zeros, ones in _decisions(keys, n):
        block, weight = _weights(zeros, ones, None if below is None else below[first, level])
        stop = (np.ones(len(first)) if below is None else np.exp(np.minimum(0.0, _HALF + block - weight)))[place]
        hits = np.where(byte >> (7 - level) & 1, ones[place], zeros[place])
        given[:, level] += left[:, level] * stop * (hits + 0.5) / (zeros + ones + 1)[place]
        left[:, level] *= 1 - stop
    return given, left


_ROW = T.StructType([T.StructField("child", T.BooleanType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("m", T.LongType()), T.StructField("v", T.BinaryType())])


def _batch(child: bool, keys, n, m, values: np.ndarray | None) -> pa.RecordBatch:
    size = len(keys)
    v = pa.nulls(size, pa.binary())
    if values is not None:
        width = values.shape[1] * values.itemsize
        v = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), size, [None, pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(np.full(size, child)), pa.array(keys), pa.array(n), pa.array(m), v], names=_ROW.names)


def _groups(batches, depth: int, column: int):
    """Whole groups of one shorter context, about STEP rows at once, of batches dealt and sorted by it."""
    waiting, size = [], 0
    for batch in batches:
        waiting.append(batch)
        size += len(batch)
        if size >= STEP:
            table = pa.Table.from_batches(waiting).combine_chunks()
            parent = _shorter(table.column(column).to_numpy(), table.column("child").to_numpy(), depth)
            cut = int(np.searchsorted(parent, parent[-1]))
            if cut:
                yield table.slice(0, cut)
                table = table.slice(cut)
            waiting, size = table.to_batches(), len(table) if cut else 0
    if waiting:
        table = pa.Table.from_batches(waiting).combine_chunks()
        if len(table):
            yield table


def _shorter(keys: np.ndarray, child: np.ndarray, depth: int) -> np.ndarray:
    """The context of depth - 1 of grams of that depth (child) or of the depth above."""
    return np.where(child, keys >> 8 & ((1 << 8 * max(depth - 1, 0)) - 1), keys >> 8) if depth else np.zeros(len(keys), np.int64)


def _values(table: pa.Table, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("v").to_pylist()), kind).reshape(len(table), -1)


def _dealt(rows: DataFrame, depth: int) -> DataFrame:
    mask = F.lit((1 << 8 * max(depth - 1, 0)) - 1).cast("long")
    above = F.shiftright("key", 8)
    parent = F.when(F.col("child"), above.bitwiseAND(mask)).otherwise(above) if depth else F.lit(0).cast("long")
    return rows.withColumn("parent", parent).repartition("parent").sortWithinPartitions("parent", "child", "key").select(*_ROW.names)


def _summed_up(partial: DataFrame, context: int) -> DataFrame:
    """Grams with their whole counts (child) and, from the same pass, those of the next shorter contexts."""

    def run(batches):
        for table in _summed(batches, context):
            keys, n, m = (table.column(c).to_numpy() for c in ("key", "n", "m"))
            parent = _shorter(keys, np.True_, context)
            yield _batch(True, keys, n, m, None)
            yield _batch(False, *(lambda k, c, s: (k, c, c, s))(*_folded(parent, keys, n, None)))

    return saved(_dealt(partial, context).mapInArrow(run, _ROW))


def _summed(batches, context: int):
    """Whole groups with equal grams summed, however many tasks counted them."""
    held = None
    for batch in batches:
        keys, n, m = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("key", "n", "m"))
        if not len(keys):
            continue
        if held is not None:
            keys, n, m = (np.concatenate(x) for x in zip(held, (keys, n, m)))
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))  # sorted: equal grams stand together
        held = keys[first], np.add.reduceat(n, first), np.add.reduceat(m, first)
        if len(first) >= STEP:
            parent = _shorter(held[0], np.True_, context)
            cut = int(np.searchsorted(parent, parent[-1]))
            if cut:
                yield pa.table(dict(zip(("key", "n", "m"), (x[:cut] for x in held))))
                held = tuple(x[cut:] for x in held)
    if held is not None:
        yield pa.table(dict(zip(("key", "n", "m"), held)))


def _folded_up(rows: DataFrame, depth: int) -> DataFrame:
    """From grams of a depth those of the next shorter contexts."""

    def run(batches):
        for table in _groups(batches, depth, 1):
            keys, n = table.column("key").to_numpy(), table.column("n").to_numpy()
            shorter, counts, sums = _folded(_shorter(keys, np.True_, depth), keys, n, _values(table, float))
            yield _batch(True, shorter, counts, counts, sums)

    return saved(_dealt(rows, depth).mapInArrow(run, _ROW))


def _handed_down(rows: DataFrame, above: DataFrame | None, depth: int, last: bool) -> DataFrame:
    """Mixtures of the grams of a depth, given those of the depth above; at full depth log10 probabilities (key, m, p)."""
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("m", T.LongType()), T.StructField("p", T.DoubleType())]) if last else _ROW

    def run(batches):
        for table in _groups(batches, depth, 1):
            child = table.column("child").to_numpy()
            whole, own = table.filter(pa.array(~child)), table.filter(pa.array(child))
            keys, n, m = (own.column(c).to_numpy() for c in ("key", "n", "m"))
            given, left = np.zeros((len(keys), 8)), np.ones((len(keys), 8))
            if depth:
                wanted = _shorter(keys, np.True_, depth) << 8 | keys & 255
                handed = _values(whole, np.float32)[np.searchsorted(whole.column("key").to_numpy(), wanted)]
                given, left = handed[:, :8].astype(float), handed[:, 8:].astype(float)
            given, left = _mixed(keys, n, None if last else _values(own, float), given, left)
            if last:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(m), pa.array(np.log10(given).sum(1))], names=schema.names)
            else:
                yield _batch(False, keys, n, m, np.concatenate([given, left], axis=1).astype(np.float32))

    both = rows if above is None else rows.unionByName(above)
    return saved(_dealt(both, depth).mapInArrow(run, schema))


def gram_scores(partial: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(key, m, p): every gram with its occurrences and its log10 probability under the weighted tree.

    partial: (key, n, m) in any number of parts; n counts training texts, m all that will be scored.
    """
    first = _summed_up(partial.withColumns({"child": F.lit(True), "v": F.lit(None).cast("binary")}), context)
    levels = {context: first.where("child"), context - 1: first.where("NOT child").withColumn("child", F.lit(True))}
    for depth in range(context - 1, 0, -1):
        levels[depth - 1] = _folded_up(levels[depth], depth)
    above = None
    for depth in range(context + 1):
        above = _handed_down(levels[depth], above, depth, depth == context)
    return above


def _partial_sums(batches_of_arrays):
    """Sums of (keys, n, m) arrays by key, given out whenever many keys are held."""

    def summed(parts):
        keys, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        return keys, *(np.bincount(inverse, np.concatenate([p[i] for p in parts]), len(keys)).astype(np.int64) for i in (1, 2))

    held, waiting = [], 0
    for part in batches_of_arrays:
        held.append(part)
        waiting += len(part[0])
        if waiting > 2 * HELD:
            whole = summed(held)
            if len(whole[0]) > HELD:
                yield whole
                held, waiting = [], 0
            else:
                held, waiting = [whole], len(whole[0])
    if held:
        yield summed(held)


def _counted_grams(rows: DataFrame, context: int) -> DataFrame:
    """Partial (key, n, m) of the rows' grams: n in training texts, m in all."""
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("key", "n", "m")])

    def parts(batches):
        for batch in batches:
            for lo, hi in chunks(batch.column(0)):
                chunk = Chunk(batch.column(0).slice(lo, hi - lo))
                keys, at = grams(chunk.data, chunk.offsets, context)
                trains = batch.column(1).slice(lo, hi - lo).to_numpy(zero_copy_only=False)
                one, inverse = np.unique(keys, return_inverse=True)
                yield one, np.bincount(inverse, np.repeat(trains, np.diff(at)), len(one)), np.bincount(inverse, minlength=len(one))

    def run(batches):
        for keys, n, m in _partial_sums(parts(batches)):
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n), pa.array(m)], names=schema.names)

    ship_package(rows.sparkSession)
    return rows.select("text", "train").mapInArrow(run, schema)


def _counted_words(rows: DataFrame) -> DataFrame:
    """(kind, key, n): word hashes and texts of the rows."""
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.LongType()), T.StructField("n", T.LongType())])

    def run(batches):
        texts = 0

        def parts():
            nonlocal texts
            for batch in batches:
                for lo, hi in chunks(batch.column(0)):
                    chunk = Chunk(batch.column(0).slice(lo, hi - lo))
                    lowered = LOWER[chunk.data]
                    starts, ends, _ = word_spans(lowered, chunk.offsets)
                    keys, n = np.unique(span_hashes(lowered, starts, ends).view(np.int64), return_counts=True)
                    texts += len(chunk)
                    yield keys, n, n

        rows_of = lambda kind, keys, n: pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(n)], names=schema.names)
        for keys, n, _ in _partial_sums(parts()):
            yield rows_of(WORD, keys, n)
        yield rows_of(TEXTS, np.zeros(1, np.int64), np.array([texts]))

    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, schema).groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _least_frequent(df: DataFrame, count: str, room: int) -> tuple[float, list]:
    """The least count such that at most ``room`` keys reach it (counts by quarters of a power of two), and those sums."""
    steps = df.where(F.col(count) > 0).groupBy(F.floor(4 * F.log2(count)).alias("b")).agg(F.count("*").alias("k"), F.sum(count).alias("s")).collect()  # at most 256
    least = max((r.b for r in steps), default=0) + 1
    for r in sorted(steps, key=lambda r: -r.b):
        if r.k > room:
            break
        room, least = room - r.k, r.b
    if all(r.b >= least for r in steps):
        least = -1
    return least, steps


def held_out(id_col: str = "doc_id", parts: int = 7) -> Column:
    """crc32 of the id as text leaves 2 modulo ``parts``; false where the id is null."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == 2, F.lit(False))


def _pairs(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = df.select("key", "n").toArrow()
    return table.column(0).to_numpy(), table.column(1).to_numpy()


def score_texts(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT, frequent_words: int = FREQUENT_WORDS, frequent_grams: int = FREQUENT_GRAMS) -> DataFrame:
    """A row for each row of docs: id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    ``training`` tells the rows to learn from. score is the tree's log10 probability of the text with its
    end, base_score that of the add-one unigram over words and the end. Null texts count as empty; without
    training rows the estimates are those of empty counts. Repeated rows count each time and are scored
    alike; empty docs give no rows; other columns are not read; words are known by 64-bit hashes, grams
    exactly. frequent_words and frequent_grams change only what is broadcast and what is joined.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    counts = saved(_counted_words(rows.where("train").select("text")))
    words = counts.where(F.col("kind") == WORD).select("key", "n")
    texts = counts.where(F.col("kind") == TEXTS).agg(F.sum("n")).first()[0] or 0
    least_word, by_size = _least_frequent(words, "n", frequent_words)
    total, distinct = texts + sum(r.s for r in by_size), (texts > 0) + sum(r.k for r in by_size)
    model = gram_scores(_counted_grams(rows, context), context)
    least_gram, _ = _least_frequent(model, "m", frequent_grams)
    at_least = lambda count, least: F.floor(4 * F.log2(count)) >= least
    frequent = spark.sparkContext.broadcast(_sorted_pairs(words.where(at_least("n", least_word)).select("key", "n")))
    known = spark.sparkContext.broadcast(_sorted_pairs(model.where(at_least("m", least_gram)).select("key", F.col("p").cast("float"))))
    unit = math.log10(total + distinct + 1)
    end_score = math.log10(texts + 1) - unit

    def found(keys, values, wanted):
        if not len(keys):
            return np.zeros(len(wanted), bool), np.zeros(len(wanted))
        place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = keys[place] == wanted
        return hit, np.where(hit, values[place], 0.0)

    def lists(one, inverse, hit, borders):
        rare = np.flatnonzero(~hit[inverse])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, borders).astype(np.int32)), pa.array(one[inverse[rare]]))

    def make():
        word_keys, word_counts = frequent.value
        worth = np.log10(word_counts + 1.0) - unit

        def step(chunk, batch):
            keys, at = grams(chunk.data, chunk.offsets, context)
            one, inverse = np.unique(keys, return_inverse=True)
            hit, value = found(*known.value, one)
            score, gram_tail = np.add.reduceat(value[inverse], at[:-1]), lists(one, inverse, hit, at)
            lowered = LOWER[chunk.data]
            starts, ends, first = word_spans(lowered, chunk.offsets)
            one, inverse = np.unique(span_hashes(lowered, starts, ends).view(np.int64), return_inverse=True)
            hit, value = found(word_keys, worth, one)
            running = np.concatenate([[0.0], np.cumsum(value[inverse])])
            hits = np.concatenate([[0], np.cumsum(hit[inverse])])
            return {
                "n_tokens": np.diff(first) + 1, "n_frequent": hits[first[1:]] - hits[first[:-1]], "base": running[first[1:]] - running[first[:-1]] + end_score,
                "part": score, "n_bytes": np.diff(at), "tail": lists(one, inverse, hit, first), "gram_tail": gram_tail,
            }

        return step

    kinds = [("n_tokens", T.LongType()), ("n_frequent", T.LongType()), ("base", T.DoubleType()), ("part", T.DoubleType()), ("n_bytes", T.LongType()), ("tail", T.ArrayType(T.LongType())), ("gram_tail", T.ArrayType(T.LongType()))]
    partly = saved(map_texts(rows, "text", make, T.StructType([T.StructField(*k) for k in kinds]), ["id", "train"]).withColumn("row", F.monotonically_increasing_id()))
    rare_words = words.where(~at_least("n", least_word)).select("key", "n")
    tail = partly.select("row", F.explode("tail").alias("key")).join(rare_words, "key", "left")
    tail = tail.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 1) - F.lit(unit)).alias("tail_score"), F.count("n").alias("tail_known"))
    gram_tail = partly.select("row", F.explode("gram_tail").alias("key")).join(model.where(~at_least("m", least_gram)).select("key", "p"), "key").groupBy("row").agg(F.sum("p").alias("gram_score"))
    score = F.col("part") + F.coalesce("gram_score", F.lit(0.0))
    return partly.drop("tail", "gram_tail").join(tail, "row", "left").join(gram_tail, "row", "left").select(
        F.col("id").alias(id_col), (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_frequent") + F.coalesce("tail_known", F.lit(0)) + F.lit(1 if texts else 0)).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("tail_score", F.lit(0.0))).alias("base_score"), score.alias("score"), (-score / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def _sorted_pairs(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order with their values, on the driver: at most FREQUENT_WORDS or FREQUENT_GRAMS rows."""
    table = df.toArrow()
    keys, values = table.column(0).to_numpy(), table.column(1).to_numpy()
    order = np.argsort(keys)
    return keys[order], values[order]
