"""The corpus pipeline: quality classifier, near-duplicate removal, secret scan, mixing, packing.

Each stage is a function of (spark, docs, sf_dir). run() writes each stage's rows as Parquet in the shared folder and reads them again
for the next. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketspark.llm import mixing, near_copies, packing, quality_classifier, secrets
from docketspark.llm.common import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; trained on the labelled ones among docs outside the held-out fold.

    Null and empty texts score like the sample's mean; repeated rows stay; an empty table gives none.
    """
    model = quality_classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_classifier.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with similar five-word shingles (0.8 or more): the one with the smallest doc_id.

    Texts without words are one group; null ids come last; of rows with the same id and words one stays; an empty table gives no rows.
    """
    return near_copies.keep_one_per_group(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, confirmed secrets replaced by a mark; n_chars follows the text.

    Null texts, null sizes and repeated rows stay as they are; a document's source stands for its path.
    """
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, once for each time.

    Documents without words are not taken; a null source is a source of its own; equal documents are taken or left together.
    """
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents. A null text counts as empty and is one piece of the end sign; repeated documents are packed like others."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality_classifier", quality), ("simhash_near_dedup", near_duplicates), ("secret_scans", secret_scan), ("mixing", mix), ("best_fit_packing", pack)]

#: SQL cannot express trained models, tokenizers and packing; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        rows = materialize(stage(spark, rows, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, rows, sf_dir)
