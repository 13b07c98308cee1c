"""Token counts of documents through a cache of digests.

A document's digest is that of its content after normalisation (runs of ASCII white space become one space, none at the
ends), which the given tokenizers cannot tell apart. Digests are joined to the stored counts of the same tokenizer
version; each distinct digest without a count is encoded once, and its count is appended to the cache.
"""

from __future__ import annotations

import hashlib
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import encoder, numbered, rows_of, work_root

CACHE = "digest binary, version string, n_tokens long"
MAX_TOKENS = 2048


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer's file and of the version of the library that reads it."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    return hashlib.sha256(Path(path).read_bytes() + library.encode()).hexdigest()


def new_cache(spark: SparkSession) -> str:
    """The path of a cache that does not exist yet, in the shared folder."""
    return f"{work_root(spark)}/docketspark/token-counts-{uuid.uuid4().hex}"


def _stored(spark: SparkSession, path: str, version: str) -> DataFrame:
    """The cache's counts for one tokenizer version; each digest once, though two runs may have appended it."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    return spark.read.schema(CACHE).parquet(path).filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, text: str = "text", collapse: bool = True) -> DataFrame:
    """All columns of docs, then n_bytes (UTF-8) and n_tokens; columns of docs with these names are replaced.

    Null text counts as empty (0 bytes, 0 tokens). collapse=False is for tokenizers to which white space matters: then only
    equal texts share a count. cache: a Parquet folder, made if missing; without it the counts are kept for this call only.
    """
    spark = docs.sparkSession
    path, version = cache or new_cache(spark), tokenizer_version(tokenizer)
    names = docs.columns
    docs, (text,) = numbered(docs, text)
    content = F.coalesce(F.col(text), F.lit(""))
    if collapse:
        content = F.trim(F.regexp_replace(content, r"[\x20\x09-\x0D]+", " "))
    by_digest = F.unhex(F.sha2(content, 256))

    stored = _stored(spark, path, version)
    seen = docs.select(by_digest.alias("digest"), content.alias("body"))
    misses = seen.join(stored, "digest", "left_anti").dropDuplicates(["digest"])

    def run(batches):
        for part, texts in rows_of(batches, "body"):
            counts = [len(ids) // 4 for ids in encoder(tokenizer).encode(texts)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    counted = misses.mapInArrow(run, "digest binary, n_tokens long")
    counted.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").option("compression", "zstd").parquet(path)

    counts = _stored(spark, path, version)
    kept = [(c, n) for c, n in zip(docs.columns, names, strict=True) if n.lower() not in ("n_bytes", "n_tokens")]
    rows = docs.select(*[c for c, _ in kept], F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), by_digest.alias("own"))
    out = rows.join(counts, F.col("own") == F.col("digest")).select(*[c for c, _ in kept], "n_bytes", "n_tokens")
    return out.toDF(*[n for _, n in kept], "n_bytes", "n_tokens")
