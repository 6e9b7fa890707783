"""Phrase collocation mining over compressed position bitmaps.

A task cuts its documents into shards. In a shard every word has a bitmap of its positions, of which only the
64-bit blocks that are not empty are kept; between two pieces of text lies an empty position. A phrase's bitmap
marks its last words: shifted by one and ANDed with a word's bitmap it is the longer phrase's, whose popcount is
its frequency in the shard. Phrases are extended depth-first from blocks of first words, and popcounts are summed
over the shards. A phrase can only be frequent where its parts are, so words and phrases of each length are
counted one length after the other, and what cannot be frequent gets no bitmap.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Chunk, saved, scratch, ship_package
from .textkit import _LANES, LOWER, U, mix, span_hashes, word_spans

MAX_WORDS, MIN_COUNT, INSIDE_PERCENT, PER_LANGUAGE, SCALE = 4, 30, 80, 2000, 2_000_000
#: Bytes of text of a shard (a longer text is one of its own), entries of bitmaps that are extended at once, and
#: bits of the filter of frequent phrases (it only saves work: what is frequent always passes).
SHARD_BYTES, ENTRIES, FILTER_BITS = 2 << 20, 1 << 15, 1 << 25
#: Languages' rows are ranked in so many parts first.
PARTS = 64

_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D, *b".,;:!?"]] = False
_BREAK = np.zeros(256, bool)
_BREAK[[0x0A, 0x0B, 0x0C, 0x0D, *b".,;:!?"]] = True
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[0x20] = False


class Filter:
    """A set of hashes in FILTER_BITS bits; what was put in is always found."""

    def __init__(self, blocks: np.ndarray):
        self.blocks = blocks

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & U(FILTER_BITS - 1)
        return (self.blocks[at >> U(6)] >> (at & U(63)) & U(1)).astype(bool)


def phrase_hashes(words: np.ndarray) -> np.ndarray:
    """Hashes of phrases from the hashes of their words, a row each."""
    out = np.full(len(words), words.shape[1], U)
    for j in range(words.shape[1]):
        out += words[:, j] * _LANES[j]
    return mix(out)


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words between single spaces, and each text's first word."""
    chunk = Chunk(texts)
    starts, ends, first = word_spans(chunk.data, chunk.offsets, _NOT_SPACE)
    return span_hashes(chunk.data, starts, ends), first


def _in_language(words: np.ndarray, langs: pa.Array, row: np.ndarray) -> np.ndarray:
    names = langs.dictionary_encode() if not isinstance(langs, pa.DictionaryArray) else langs
    chunk = Chunk(names.dictionary)
    of = mix(span_hashes(chunk.data, chunk.offsets[:-1], chunk.offsets[1:]))
    return mix(words ^ of[names.indices.to_numpy()[row]])


def frequent_filter(frequent: DataFrame) -> Broadcast:
    """The filter of the phrases of ``frequent``(lang, phrase), which has one size for any number of them."""

    def run(batches):
        blocks = np.zeros(FILTER_BITS >> 6, U)
        for batch in batches:
            words, first = _hashes(batch.column(1))
            words = _in_language(words, batch.column(0), np.repeat(np.arange(len(batch)), np.diff(first)))
            at = phrase_hashes(words.reshape(len(batch), -1)) & U(FILTER_BITS - 1) if len(batch) else np.zeros(0, U)
            np.bitwise_or.at(blocks, at >> U(6), U(1) << (at & U(63)))
        used = np.flatnonzero(blocks)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(blocks[used].view(np.int64))], names=["block", "bits"])

    spark = frequent.sparkSession
    ship_package(spark)
    rows = frequent.select("lang", "phrase").mapInArrow(run, "block long, bits long").groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()
    blocks = np.zeros(FILTER_BITS >> 6, U)
    blocks[rows.column(0).to_numpy()] = rows.column(1).to_numpy().view(U)
    return spark.sparkContext.broadcast(blocks)


@dataclass
class Words:
    """The words of some texts in order: position (pieces are one apart), number in ``names``, and language."""

    position: np.ndarray
    name: np.ndarray
    names: pa.Array
    lang: np.ndarray
    langs: pa.Array

    @classmethod
    def of(cls, langs: pa.Array, texts: pa.Array) -> Words:
        chunk = Chunk(texts)
        lowered = LOWER[chunk.data]
        starts, ends, first = word_spans(lowered, chunk.offsets, _IN_WORD)
        text = np.repeat(np.arange(len(chunk)), np.diff(first))
        breaks = np.cumsum(_BREAK[lowered])[starts] if len(starts) else starts
        changes = (np.diff(breaks) != 0) | (np.diff(text) != 0)
        position = np.arange(len(starts)) + np.concatenate([[0], np.cumsum(changes)])[: len(starts)]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)])
        names = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(lowered[_IN_WORD[lowered]]))).dictionary_encode()
        tongue = langs.dictionary_encode()
        return cls(position, names.indices.to_numpy(), names.dictionary, tongue.indices.to_numpy()[text], tongue.dictionary)

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every different (language, name): language, name, how often, and which of them each word is."""
        pair = self.lang.astype(np.int64) * max(len(self.names), 1) + self.name
        one, which, times = np.unique(pair, return_inverse=True, return_counts=True)
        return one // max(len(self.names), 1), one % max(len(self.names), 1), times, which


@dataclass
class Batch:
    """Bitmaps of some phrases, ordered by phrase: entries (phrase, block, bits), and each phrase's words."""

    phrase: np.ndarray
    block: np.ndarray
    bits: np.ndarray
    words: np.ndarray

    def counts(self) -> np.ndarray:
        return np.add.reduceat(np.bitwise_count(self.bits).astype(np.int64), np.flatnonzero(np.diff(self.phrase, prepend=-1))) if len(self.phrase) else np.zeros(0, np.int64)


class Shard:
    """The words' bitmaps of some texts, and the entry in which each position's bit stands."""

    def __init__(self, words: Words, word: np.ndarray, n_words: int, hashes: np.ndarray, filters: list[Filter]):
        """word: the number of each word, -1 for those without a bitmap; hashes: of the words by number."""
        kept = np.flatnonzero(word >= 0)
        position, self.hashes, self.filters = words.position[kept], hashes, filters
        n_blocks = (int(words.position[-1]) >> 6) + 2 if len(words.position) else 2
        key = word[kept].astype(np.int64) * n_blocks + (position >> 6)
        order = np.argsort(key, kind="stable")
        bit = U(1) << (position & 63).astype(U)
        begins = np.flatnonzero(np.diff(key[order], prepend=-1))
        entry = np.zeros(len(kept), np.int64)
        entry[order] = np.cumsum(np.diff(key[order], prepend=-1) != 0) - 1
        self.at = np.full(n_blocks * 64, -1, np.int64)
        self.at[position] = entry
        self.used = np.zeros(n_blocks, U)
        np.bitwise_or.at(self.used, position >> 6, bit)
        first = key[order][begins]
        self.word, self.block = first // n_blocks, first % n_blocks
        self.bits = np.bitwise_or.reduceat(bit[order], begins) if len(begins) else np.zeros(0, U)

    def firsts(self):
        """Batches of one-word phrases, about ENTRIES entries each; a word's entries stay together."""
        begins = np.append(np.flatnonzero(np.diff(self.word, prepend=-1)), len(self.word))
        lo = 0
        while lo < len(begins) - 1:
            hi = max(lo + 1, int(np.searchsorted(begins, begins[lo] + ENTRIES, "right")) - 1)
            a, b = begins[lo], begins[hi]
            yield Batch(self.word[a:b] - self.word[a], self.block[a:b], self.bits[a:b], np.arange(self.word[a], self.word[b - 1] + 1)[:, None])
            lo = hi

    def extended(self, batch: Batch) -> Batch:
        """All phrases of one word more that the batch's bitmaps, shifted, have in common with the words' bitmaps."""
        carry = batch.bits >> U(63)
        over = np.flatnonzero(carry)
        phrase = np.concatenate([batch.phrase, batch.phrase[over]])
        block = np.concatenate([batch.block, batch.block[over] + 1])
        bits = np.concatenate([batch.bits << U(1), carry[over]]) & self.used[block]
        parts = []
        while len(live := np.flatnonzero(bits)):
            phrase, block, bits = phrase[live], block[live], bits[live]
            low = np.bitwise_count((bits & (~bits + U(1))) - U(1)).astype(np.int64)  # the lowest bit's place
            entry = self.at[block * 64 + low]
            parts.append((phrase, self.word[entry], block, bits & self.bits[entry]))
            bits = bits & ~self.bits[entry]
        if not parts:
            return Batch(*[np.zeros(0, np.int64)] * 2, np.zeros(0, U), np.zeros((0, batch.words.shape[1] + 1), np.int64))
        phrase, word, block, bits = (np.concatenate(x) for x in zip(*parts))
        k = batch.words.shape[1] + 1
        if k <= len(self.filters):  # phrases of k words were counted: go on only where this one is frequent
            may = self.filters[k - 1].has(phrase_hashes(np.column_stack([self.hashes[batch.words[phrase]], self.hashes[word]])))
        elif k > 2:  # its last k - 1 words were
            may = self.filters[k - 2].has(phrase_hashes(np.column_stack([self.hashes[batch.words[phrase][:, 1:]], self.hashes[word]])))
        else:
            may = np.ones(len(phrase), bool)
        phrase, word, block, bits = phrase[may], word[may], block[may], bits[may]
        key = phrase * max(len(self.hashes), 1) + word
        order = np.argsort(key, kind="stable")
        key = key[order]
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        new = np.cumsum(np.diff(key, prepend=-1) != 0) - 1
        return Batch(new, block[order], bits[order], np.column_stack([batch.words[phrase[order][begins]], word[order][begins]]))

    def phrases(self, n_words: int):
        """Batches of all phrases of n_words words, depth-first."""

        def deeper(batch):
            if batch.words.shape[1] == n_words:
                yield batch
            elif len(batch.phrase):
                yield from deeper(self.extended(batch))

        for batch in self.firsts():
            yield from deeper(batch)


def shards(batches):
    """(languages, texts) of about SHARD_BYTES bytes each."""
    langs, texts, size = [], [], 0
    for batch in batches:
        ends = np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(batch):
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + SHARD_BYTES - size, "right")))
            langs.append(batch.column(0).slice(at, stop - at))
            texts.append(batch.column(1).slice(at, stop - at).cast(pa.large_string()).fill_null(""))
            size += ends[stop - 1] - done
            at = stop
            if size >= SHARD_BYTES or at < len(batch):
                yield pa.concat_arrays(langs), pa.concat_arrays(texts)
                langs, texts, size = [], [], 0
    if texts:
        yield pa.concat_arrays(langs), pa.concat_arrays(texts)


def _counted(docs: DataFrame, filters: list[Broadcast]) -> DataFrame:
    """(lang, phrase, f): phrases of as many words as there are filters, and one more, whose parts may be frequent."""

    def run(batches):
        known = [Filter(f.value) for f in filters]
        for langs, texts in shards(batches):
            words = Words.of(langs, texts)
            lang, name, times, which = words.counted()
            if not known:
                for lo in range(0, len(lang), ENTRIES):
                    cut = slice(lo, lo + ENTRIES)
                    yield pa.RecordBatch.from_arrays([words.langs.take(pa.array(lang[cut])), words.names.take(pa.array(name[cut])).cast(pa.string()), pa.array(times[cut])], names=["lang", "phrase", "f"])
                continue
            plain, _ = _hashes(words.names)
            hashes = _in_language(plain[name], pa.DictionaryArray.from_arrays(pa.array(lang), words.langs), np.arange(len(lang)))
            may = known[0].has(phrase_hashes(hashes[:, None]))
            number = np.where(may, np.cumsum(may) - 1, -1)
            lang, name, hashes = lang[may], name[may], hashes[may]
            shard = Shard(words, number[which] if len(which) else which, int(may.sum()), hashes, known)
            for batch in shard.phrases(len(known) + 1):
                if not len(batch.words):
                    continue
                columns = [words.names.take(pa.array(name[batch.words[:, j]])) for j in range(batch.words.shape[1])]
                joined = pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([words.langs.take(pa.array(lang[batch.words[:, 0]])), joined, pa.array(batch.counts())], names=["lang", "phrase", "f"])

    ship_package(docs.sparkSession)
    # a shard has a phrase once, so to sum before the shuffle would only fill memory: rows are dealt as they come
    counted = docs.mapInArrow(run, "lang string, phrase string, f long").repartition("lang", "phrase")
    return counted.groupBy("lang", "phrase").agg(F.sum("f").alias("f"))


def _parts(phrase: str, n: int, first: int, last: int):
    """The words first .. last (from 1) of a phrase of n words."""
    words = F.split(phrase, " ", n)
    return F.array_join(F.slice(words, first, last - first + 1), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, inside_percent: int = INSIDE_PERCENT, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of 2 to max_words words of each language.

    Texts are lower-cased (A-Z), cut into pieces at . , ; : ! ? and line ends and into words at spaces and
    tabs; a phrase's frequency a counts all its occurrences inside pieces. Phrases of at least min_count are
    scored at their worst cut, floor(2000000 * a / (l + r)), where l and r are the frequencies of the two parts;
    ties go to the first cut. Phrases inside a longer one of inside_percent of their frequency are dropped. Ranks
    go by score and frequency downwards, then by the phrase's bytes. Null languages are 'und'; null and wordless
    texts hold nothing; repeated rows count each; a language without a phrase has no row, empty docs give none;
    other columns are not read. Counts are exact, and products are made as decimals of 38 digits. The result
    is a table in the shared folder; all other tables of the work are deleted.
    """
    with scratch(docs.sparkSession):
        source = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
        counts = saved(_counted(source, []))
        sizes = counts.groupBy("lang").agg(F.sum("f").alias("n"))
        levels = [saved(counts.where(F.col("f") >= min_count))]
        filters = []
        for _ in range(2, max_words + 1):
            if levels[-1].isEmpty():
                break
            filters.append(frequent_filter(levels[-1]))
            levels.append(saved(_counted(source, filters).where(F.col("f") >= min_count)))
        every = levels[0]
        for level in levels[1:]:
            every = every.unionByName(level)
        cuts, inner = [], []
        for n, level in enumerate(levels[1:], 2):
            for k in range(1, n):
                cuts.append(level.select("lang", "phrase", F.col("f").alias("a"), F.lit(k).alias("k"), _parts("phrase", n, 1, k).alias("left"), _parts("phrase", n, k + 1, n).alias("right")))
            for m in range(2, n):
                for at in range(1, n - m + 2):
                    inner.append(level.select("lang", _parts("phrase", n, at, at + m - 1).alias("phrase"), "f"))
        if not cuts:
            cuts = [levels[0].select("lang", "phrase", F.col("f").alias("a"), F.lit(1).alias("k"), F.col("phrase").alias("left"), F.col("phrase").alias("right")).limit(0)]
        union = lambda parts: parts[0] if len(parts) == 1 else union(parts[: len(parts) // 2]).unionByName(union(parts[len(parts) // 2 :]))
        cut = union(cuts).join(every.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"]).join(every.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
        cut = cut.withColumn("score", F.expr(f"CAST({SCALE} AS DECIMAL(18, 0)) * a div (l + r)"))
        scored = cut.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
        if inner:
            longer = union(inner).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
            wide = lambda c: F.col(c).cast("decimal(28, 0)")
            scored = scored.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < inside_percent * wide("a")))
        order = [F.desc("score"), F.desc("a"), F.col("phrase")]
        some = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
        best = scored.withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= per_language)
        ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= per_language)
        return saved(ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"), keep=True)
