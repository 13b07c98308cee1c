"""Tags as bitmaps over ids: lists that hold all or any of some tags by bit operations, and how many cases have a tag by counting bits.

A bitmap covers 32,768 consecutive ids; the index has a row per tag and range of ids in which it occurs, built by partial aggregation, so a tag that a
third of the cases has is as many rows as there are ranges. Searches group by range: a few bitmaps of 4 KB in a task at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids of a bitmap, as Spark's bitmap functions have them: range n holds the ids from (n - 1) * SPAN + 1 to n * SPAN.
SPAN = 32_768


def build(rows: DataFrame, key: str, tags: str) -> DataFrame:
    """tag, range and bits of the ids (whole numbers) that have it. Null ids, lists and tags are in no bitmap; repeated tags and rows count once."""
    pairs = rows.select(F.col(key).cast("long").alias("key"), F.explode(tags).alias("tag")).filter("key is not null and tag is not null")
    return pairs.groupBy("tag", F.bitmap_bucket_number("key").alias("range")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("key")).alias("bits"))


def _ids(bitmaps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                bits = np.frombuffer(batch.column(1)[at].as_py(), dtype=np.uint8)
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(np.unpackbits(bits, bitorder="little")) + (batch.column(0)[at].as_py() - 1) * SPAN + 1)], ["key"])

    return bitmaps.select("range", "bits").mapInArrow(run, "key long")


def with_all(index: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """key of the lists that hold all of the wanted tags (one at least)."""
    wanted = sorted(set(wanted))
    if not wanted:
        raise ValueError("no tag is wanted")
    per_range = index.filter(F.col("tag").isin(wanted)).groupBy("range").agg(F.count("*").alias("n"), F.bitmap_and_agg("bits").alias("bits"))
    return _ids(per_range.filter(F.col("n") == len(wanted)))


def with_any(index: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """key of the lists that hold any of the wanted tags; none for no tag."""
    return _ids(index.filter(F.col("tag").isin(list(wanted)) if wanted else F.lit(False)).groupBy("range").agg(F.bitmap_or_agg("bits").alias("bits")))


def counts(index: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """label and n, the number of ids that have each tag; with among (key), of those ids only. Bits are counted, no list is opened."""
    if among is not None:
        kept = among.select(F.col("key").cast("long").alias("key")).filter("key is not null")
        kept = kept.groupBy(F.bitmap_bucket_number("key").alias("range")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("key")).alias("kept"))
        both = index.join(kept, "range").select("tag", "range", F.inline(F.array(F.struct(F.col("bits").alias("b")), F.struct(F.col("kept").alias("b")))))
        index = both.groupBy("tag", "range").agg(F.bitmap_and_agg("b").alias("bits"))
    return index.groupBy(F.col("tag").alias("label")).agg(F.sum(F.bitmap_count("bits")).alias("n")).filter("n > 0")
