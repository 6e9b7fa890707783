"""SimHash groups, importance resampling and phrases against their plain versions."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graphloom.llm import catalogue, importance, phrases, simhash
from graphloom.llm.common import Chunk

from . import brute
from .conftest import SMALL
from .test_numbered import documents, rows


@pytest.fixture(params=["small", "edges"])
def folder(request, edge_dir):
    return SMALL if request.param == "small" else edge_dir


def test_simhash(spark, folder):
    got = rows(catalogue.op11_simhash(spark, folder), "doc_id", "fingerprint", "component_id")
    assert got == Counter(brute.simhashes(documents(spark, folder)))


def test_bit_counts_bound_the_differing_bits():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 4000, dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, 4000, dtype=np.uint64)
    b = a.copy()
    for k in range(3):  # up to two bits differ, or three
        b[: 3000 - 1000 * k] ^= np.uint64(1) << rng.integers(0, 64, 3000 - 1000 * k, dtype=np.uint64)
    differ = np.bitwise_count(a ^ b)
    for width in simhash.WIDTHS:
        mask = np.uint64((1 << width) - 1)
        counts = [np.stack([(simhash.points(x, width) >> np.uint64(s)) & mask for s in range(0, 64, width)]).astype(int) for x in (a, b)]
        assert (counts[0].sum(axis=0) == np.bitwise_count(a)).all()
        assert (np.abs(counts[0] - counts[1]).sum(axis=0) <= differ).all()
        dealt = []
        for x in (a, b):
            cell, who = simhash.cells(x, width)
            assert np.bincount(who).max() <= 1 + 2 * 64 // width
            dealt.append({(i, c) for i, c in zip(who.tolist(), cell.tolist())})
        meet = {i for i, _ in dealt[0] & dealt[1]}
        assert set(np.flatnonzero(differ <= 2).tolist()) <= meet


@pytest.mark.parametrize("cell", [128, 3])
def test_dense_fingerprints(spark, monkeypatch, cell):
    """Hundreds of fingerprints around one, chains, equal counts without nearness, and 0; every width is reached with small cells."""
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(5)
    base, prints = rng.getrandbits(64), set()
    for _ in range(700):
        x = base
        for b in rng.sample(range(20), rng.randrange(0, 6)):
            x ^= 1 << b
        prints.add(x)
    x = rng.getrandbits(64)
    for b in range(0, 60, 2):
        prints.add(x := x ^ (3 << b))  # each two bits from the one before
    x = rng.getrandbits(32)
    prints |= {x << 32 | x, (x << 32 | x) ^ (0b0110 << 8) ^ (0b1001 << 8), 0, 1, 7, (1 << 64) - 1}
    prints |= {rng.getrandbits(64) for _ in range(200)}
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in prints], "print long")
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df).collect()]
    root = {p: p for p in prints}

    def of(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in found:
        a, b = sorted((of(a), of(b)))
        root[b] = a
    assert {p: of(p) for p in prints} == brute.components(prints, 2)


def test_links_grow_with_the_fingerprints(spark, monkeypatch):
    """Fingerprints with many neighbours each: at most a row for each cell that one is dealt to, not one for each pair."""
    import itertools

    for m, k, pairs in ((12, 6, 18 * 924), (64, 2, 62 * 2016)):
        prints = [sum(1 << b for b in bits) for bits in itertools.combinations(range(m), k)]
        df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
        for cell in (128, 5):
            monkeypatch.setattr(simhash, "CELL", cell)
            assert simhash.links(df).count() < min(0.75 * pairs, 65 * len(prints))


def test_many_copies_of_one_text(spark):
    docs = [(i, "one text that stands here again and again") for i in range(3000)] + [(3000, None), (3001, ""), (None, "one text that stands here again and again")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in simhash.near_fingerprints(df, size=3).collect()}
    assert got == {(i, 0) for i in range(3000)} | {(3000, 3000), (3001, 3000), (None, 0)}


def test_crcs_of_words_and_runs():
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcé漢1\U0001f600") for _ in range(rng.choice([1, 2, 5, 9, 30, 47, 48, 49, 200]))) for _ in range(rng.randrange(0, 12))) for _ in range(60)] + ["", "x" * 5000]
    bucket, text, n_words = importance.buckets_of(Chunk(pa.array(texts)), 4, 1 << 31)
    want, got = [], [Counter() for _ in texts]
    for b, t in zip(bucket.tolist(), text.tolist()):
        got[t][b] += 1
    for t in texts:
        w = t.split(" ") if t else []
        want.append(Counter(zlib.crc32(" ".join(w[i : i + k]).encode()) % (1 << 31) for k in range(1, 5) for i in range(len(w) - k + 1)))
    assert got == want and n_words.tolist() == [len(t.split()) for t in texts]


def test_importance(spark, folder):
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = rows(catalogue.op12_importance_resampling(spark, folder), "doc_id", "n_features", "weight", "score", "rank")
    assert got == Counter(brute.resampled(documents(spark, folder), target))


def test_importance_of_longer_runs(spark):
    docs, target = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    found = importance.resample(docs.union(docs.limit(40)), target, max_words=3, n_buckets=500, min_words=5, percent=35, seed=7)
    got = rows(found, "doc_id", "n_features", "weight", "score", "rank")
    again = [(r.doc_id, r.text) for r in docs.union(docs.limit(40)).collect()]
    assert got == Counter(brute.resampled(again, [r.text for r in target.collect()], 3, 500, 5, 35, 7))


def test_collocations(spark, folder):
    texts = [(r.lang, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    columns = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert rows(catalogue.op13_collocations(spark, folder), *columns) == Counter(brute.collocations(texts))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = phrases.collocations(docs, max_words=3, min_count=2, inside_percent=60, per_language=50)
    assert rows(found, *columns) == Counter(brute.collocations(texts, 3, 2, 60, 50))


@pytest.mark.parametrize("entries", [1 << 18, 7])
def test_bitmaps_count_phrases(monkeypatch, entries):
    """A shard's popcounts are the phrases' occurrences, with pieces, overlaps and carries between blocks."""
    monkeypatch.setattr(phrases, "ENTRIES", entries)
    rng = random.Random(entries)
    texts = [("en" if i % 3 else "fr", "".join(rng.choice(["a", "b", "c", "Éd"]) + rng.choice([" ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randrange(0, 300)))) for i in range(20)]
    texts += [("en", "a " * 500), ("en", None), ("fr", " \t")]
    words = phrases.Words.of(pa.array([x for x, _ in texts]), pa.array([t for _, t in texts]))
    lang, name, times, which = words.counted()
    plain, _ = phrases._hashes(words.names)
    names, langs = words.names.to_pylist(), words.langs.to_pylist()
    want = brute.phrase_counts(texts)
    assert {(langs[a], names[b]): int(c) for a, b, c in zip(lang, name, times)} == {(x, w[0]): c for x, f in want.items() for w, c in f.items() if len(w) == 1}
    shard = phrases.Shard(words, which, len(lang), plain[name], [])
    monkeypatch.setattr(phrases.Filter, "has", lambda self, h: np.ones(len(h), bool))
    shard.filters = [phrases.Filter(None)] * 3
    for n in (2, 3, 4):
        got = Counter()
        for batch in shard.phrases(n):
            for w, c in zip(batch.words, batch.counts()):
                assert len({int(lang[x]) for x in w}) == 1
                got[langs[lang[w[0]]], tuple(names[name[x]] for x in w)] += int(c)
        assert got == Counter({(x, w): c for x, f in want.items() for w, c in f.items() if len(w) == n})


def test_shards_hold_every_text(monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 50)
    texts = ["x" * (i * 7 % 90) for i in range(200)] + [None]
    batches = [pa.RecordBatch.from_arrays([pa.array(["en"] * len(t)), pa.array(t, pa.string())], names=["lang", "text"]) for t in (texts[:3], texts[3:120], [], texts[120:])]
    found = [t for _, part in phrases.shards(batches) for t in part.to_pylist()]
    assert found == [t or "" for t in texts]
    assert all(len(part) == 1 or sum(map(len, part.to_pylist())) <= 50 + 90 for _, part in phrases.shards(batches))
