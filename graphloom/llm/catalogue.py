"""The numbered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_model, decontaminate, importance, language_id, licences, mixing, near_dedup, phrases, pii, quality, secrets, simhash, token_counts
from .sql import ORACLES


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _kind_counts(spans: Column, kinds: tuple[str, ...]) -> list[Column]:
    of = lambda kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    return [of(k).alias(f"n_{k}") for k in kinds]


def _digest(spans: Column, kinds: tuple[str, ...]) -> list[Column]:
    base = F.filter(spans, lambda x: x["kind"].isin(*kinds))
    return [F.sha2(pii.joined(base).cast("binary"), 256).alias("base_sha256"), pii.joined(spans).alias("spans")]


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by four-word shingles at similarity 0.8."""
    return near_dedup.near_duplicates(_documents(spark, sf_dir), size=4)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data in all documents: counts and digest of the base kinds, and all spans."""
    found = pii.find_personal_data(_documents(spark, sf_dir).select("doc_id", "text"), out_col="found")
    # one array and one lambda: the spans are made once for each row
    made = pii.let(F.col("found"), lambda x: F.struct(*_kind_counts(x, pii.BASE), *_digest(x, pii.BASE)))
    return found.select("doc_id", made.alias("made")).select("doc_id", "made.*")


def op3_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Exact token counts of all documents; ``tokenizer`` is the vocabulary file's path."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.token_counts(_documents(spark, sf_dir), Path(tokenizer).read_text(), 2048, keep=["doc_id"])


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths of all documents under the context trees learned from those that are not held out."""
    return byte_model.score_texts(_documents(spark, sf_dir), ~byte_model.held_out())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of all documents and the cascade's verdict."""
    rows = quality.judged(_documents(spark, sf_dir).select("doc_id", "text"), with_features=True)
    q = rows.select("doc_id", "quality.*", "rejected_by")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return q.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("rejected_by").isNull()).alias("kept"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document's words are taken so that sources come near their targets."""
    return mixing.mix_sources(_documents(spark, sf_dir)).withColumn("target", F.round("target", 4)).drop("source")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents: counts and digest of the base kinds, and all spans."""
    found = secrets.find_secrets(_documents(spark, sf_dir), keep=["doc_id"])
    spans = F.col("secrets")
    return found.select("doc_id", *_kind_counts(spans, secrets.KINDS[:3]), *_digest(spans, secrets.KINDS[:3]))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by profiles learned outside the held-out quarter."""
    docs = _documents(spark, sf_dir)
    model = language_id.train(docs.where(~language_id.held_out()))
    out = language_id.identify(docs, model, keep=["doc_id"])
    return out.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents inside benchmark windows, and whose windows they are."""
    found = decontaminate.contaminated_words(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])
    n_hit = F.size("hit_words").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence sentences of all documents and the licences whose rules they fit."""
    found = licences.find_licences(_documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", F.array_join("licence_sentences", " ").alias("sentences"), F.array_join("licences", ",").alias("licences"), F.size("licences").cast("long").alias("n_licences"), "partly")


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents by three-word shingles, grouped at two differing bits."""
    found = simhash.near_fingerprints(_documents(spark, sf_dir), size=3, bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents towards the benchmark's texts, and which tenth of the longer ones is drawn."""
    found = importance.resample(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), max_words=1)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best phrases of each language in all documents."""
    return phrases.collocations(_documents(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    numbered = (op1_near_duplicates, op2_personal_data, op3_token_counts, op4_language_model, op5_quality_rules, op6_mix_sources, op7_secrets, op8_language_id, op9_decontamination, op10_licences, op11_simhash, op12_importance_resampling, op13_collocations)
    return {f.__name__: f for f in (*numbered, pipeline)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
