"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, divergence, filter_audit, lm_scoring, mixing, packing, pii, quality_classifier, quality_rules, repeats, secrets, simhash, token_counts

from .common import fold


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return mixing.mixture(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    return quality_rules.judge(_documents(spark, sf_dir))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = _documents(spark, sf_dir)
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality_classifier.scored(docs, model)
    predicted = (F.col("score") >= quality_classifier.THRESHOLD).cast("int")
    return out.select("doc_id", (fold("doc_id", quality_classifier.FOLDS) == 0).alias("held_out"), "score", predicted.alias("predicted"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    return packing.pack_documents(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and byte-model log10 probabilities of every document."""
    return lm_scoring.score_texts(_documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document: base counts and digest, all spans, and their scores in the same order."""
    found = pii.personal_data(_documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("email", "ip", "card", "phone")]
    return found.select("doc_id", *counts, F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth; orderings until 0.995 of them are found for the measured queries."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20, recall=0.995).select("query_id", "rank", "vec_id", "score")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document; the cache starts empty and lives as long as the query's tables."""
    counted = token_counts.count_tokens(_documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > token_counts.MAX_TOKENS).alias("over_limit"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    out = simhash.near_duplicate_groups(_documents(spark, sf_dir))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and confirmed secrets of every document; secrets as start:end, comma-joined (code points, end exclusive)."""
    found = secrets.report(_documents(spark, sf_dir))
    places = F.transform("secrets", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "n_candidates", "n_secrets", F.array_join(places, ",").alias("spans"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove, behind each other in every order, per language."""
    return filter_audit.audit_documents(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the bytes of strings of 400 that also start elsewhere."""
    return repeats.removals(_documents(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every source's divergence from the others of its language, and the terms that set it apart."""
    return divergence.source_divergence(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_quality_rules": op2_quality_rules,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_packing": op4_packing,
        "op5_lm_scoring": op5_lm_scoring,
        "op6_pii": op6_pii,
        "op7_ann": op7_ann,
        "op8_token_counts": op8_token_counts,
        "op9_simhash": op9_simhash,
        "op10_secret_scans": op10_secret_scans,
        "op11_filter_audit": op11_filter_audit,
        "op12_suffix_dedup": op12_suffix_dedup,
        "op13_source_divergence": op13_source_divergence,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_filter_audit": filter_audit.SQL, "op12_suffix_dedup": repeats.SQL, "op13_source_divergence": divergence.SQL}
