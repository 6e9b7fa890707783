"""The pipeline against its plain version, and its stages on rows at the edges."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from graphloom.llm import language_id, near_dedup, secrets

from . import brute
from .conftest import SMALL


def test_pipeline_by_brute_force(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    kept = {d: r.text for d, r in docs.items() if any(c.isalpha() for c in r.text or "")}
    groups = brute.near_duplicates(kept.items(), 5)
    kept = {d: t for d, t in kept.items() if groups[d][1] == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    hit = {d for d, _, n, _, _ in brute.contamination(kept.items(), items) if n}
    kept = {d: secrets.redacted(t, secrets.spans_of(t), "[SECRET]") for d, t in kept.items() if d not in hit}
    stage = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, function in corpus_pipeline.STAGES[:-1]:
        stage = function(spark, stage, SMALL)
    assert {r.doc_id: r.text for r in stage.collect()} == kept  # which documents stay, and what of them
    sizes = Counter()
    for d, t in kept.items():
        sizes[docs[d].source] += len(brute.words(t))
    want, taken = brute.targets(sizes), Counter()
    got = corpus_pipeline.run(spark, SMALL).collect()
    for r in got:
        assert r.size == len(brute.words(kept[r.doc_id])) and 0 < r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)


def test_stages_on_edges(spark, edges, edge_dir):
    docs = edges
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, edge_dir)
        assert out.columns == docs.columns, name
        docs = out
    ids = sorted(r.doc_id for r in docs.collect() if r.doc_id is not None)
    assert 1 not in ids and 6 not in ids and len(ids) == len(set(ids))


CLASHING = "score lang_pred n_words items hit_words secrets redacted n_tokens __text row rest_key text_key group_key kept id component_id size taken".split()


def test_stages_leave_other_columns_alone(spark, edge_dir, edges):
    docs = edges.drop("n_tokens").select("*", *[F.concat(F.lit(c), F.col("doc_id")).alias(c) for c in CLASHING])
    ids = edges.where("doc_id IS NOT NULL").select("doc_id").distinct().count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, edge_dir)
        assert out.columns == docs.columns and out.schema == docs.schema or [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        found = out.collect()
        assert 0 < len(found) <= ids + 2, name
        for r in found:
            assert all(r[c] == (None if r.doc_id is None else f"{c}{r.doc_id}") for c in CLASHING), (name, r)
    mixed = corpus_pipeline.mixture(spark, docs, edge_dir)
    assert mixed.columns == ["doc_id", "source", "size", "source_size", "target", "taken"] and mixed.count() > 0


def test_one_document_of_each_group(spark, empty_dir):
    """Rows of one id: different texts are different documents, near copies and repeats are one."""
    long = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    docs = [(5, long(1), "a"), (5, long(2), "a"), (5, long(2) + " end", "b"), (6, long(2), "c"), (7, long(3), "q"), (7, long(3), "p"), (7, long(3), "p"), (None, long(3), "n"), (None, long(4), "n"), (None, long(4), "m"), (8, "", "e"), (8, "", "e"), (9, None, "e")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    results = []
    for parts in (1, 7):
        results.append(sorted(map(str, corpus_pipeline.near_duplicates(spark, df.repartition(parts), empty_dir).collect())))
    assert results[0] == results[1]
    got = corpus_pipeline.near_duplicates(spark, df, empty_dir).collect()
    texts = [r.text for r in got]
    assert texts.count(long(1)) == 1 and sum(t in (long(2), long(2) + " end") for t in texts) == 1
    assert texts.count(long(3)) == 1 and texts.count(long(4)) == 1 and texts.count("") == 2 and texts.count(None) == 1
    assert {r.doc_id for r in got if r.text == long(3)} == {7} and len(got) == 7


def test_prefixes_of_near_copies(spark, empty_dir, monkeypatch):
    """The stage makes prefixes for the labels of near copies, and keeps one of them."""
    import random

    rng = random.Random(4)
    word = lambda: "w" + str(rng.randrange(10**7))
    base = [word() for _ in range(200)]
    rows = [(i, " ".join([*base[:k], word(), *base[k + 1 :]]), "en", "a") for i in range(300) for k in [rng.randrange(200)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    made, labels = [], []
    split_join = near_dedup.split_join

    def seen(table, per_key, key, *more):
        if key == "part":
            made.append(table.count())
        elif key == ["region", "label"]:
            labels.append((per_key.count(), table.count()))
        return split_join(table, per_key, key, *more)

    monkeypatch.setattr(near_dedup, "split_join", seen)
    kept = corpus_pipeline.near_duplicates(spark, docs, empty_dir)
    assert [r.doc_id for r in kept.collect()] == [0]
    (few, sets), (rows_made,) = labels[0], made
    assert sets > 2 * few and rows_made == (near_dedup.DEPTH - near_dedup.MIN_DEPTH) * few


def test_language_stage_decides(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    foreign = ["Это русский текст о погоде и людях, который стоит здесь", "这是一个中文句子没有空格而且很长", "0x1f a"]
    more = spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate([*foreign, "123 !", None])], "doc_id long, text string, lang string")
    both = docs.unionByName(more)
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert ids(corpus_pipeline.language(spark, both, SMALL)) == ids(docs)
    unlabelled = both.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert ids(corpus_pipeline.language(spark, unlabelled, SMALL)) == ids(docs) | {-1, -2, -3}


def test_least_score_counts_all_labelled_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("text", "lang")
    many = docs.crossJoin(spark.range(20))
    model = language_id.train(docs)
    scores = sorted(r.score for r in language_id.identify(many, model, keep=[]).where("lang_pred != 'und'").collect())
    least = language_id.least_score(many, model)
    below = sum(int(x * language_id.SCALE) < round(least * language_id.SCALE) for x in scores)
    assert below * language_id.ONE_IN <= len(scores) and int(scores[len(scores) // language_id.ONE_IN] * language_id.SCALE) == round(least * language_id.SCALE)
