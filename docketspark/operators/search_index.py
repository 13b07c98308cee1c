"""Substring search by an inverted index of three-character grams: lists of the keys whose text holds a gram, intersected, then verified.

A gram's list is cut into parts by a hash of the key, so that a gram of every text is many rows; a search intersects lists part by part, and no task
holds more than a token's lists of a part. The index lies sorted by gram, so a search reads little but its own grams.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketspark.sources.snapshots import keep

GRAM = 3
#: Keys of a list's part, on average, for a gram that every text holds.
PART_KEYS = 10_000
#: Characters that are sorted at a time.
PIECE_CHARS = 2_000_000


def grams_of(text: str, n: int = GRAM) -> list[str]:
    """The distinct runs of n characters, sorted."""
    return sorted({text[i : i + n] for i in range(len(text) - n + 1)})


def gram_owners(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a gram (three code points in one number) and the text that holds it, by gram and then by text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le"), dtype="<u4").astype(np.int64)
    if len(chars) < GRAM:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)
    inside = owner[: 1 - GRAM] == owner[GRAM - 1 :]
    gram, owner = (chars[:-2] << 42 | chars[1:-1] << 21 | chars[2:])[inside], owner[: 1 - GRAM][inside]
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    new = np.concatenate([[True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])])[: len(gram)]
    return gram[new], owner[new]


def gram_strings(grams: np.ndarray) -> list[str]:
    """The texts of grams that gram_owners() has numbered."""
    chars = np.stack([grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le")
    return [chars[i : i + GRAM] for i in range(0, len(chars), GRAM)]


def build(texts: DataFrame, key: str, text: str, parts: int | None = None) -> DataFrame:
    """gram, part, keys (sorted, distinct) over the lower-cased texts; written to the shared folder. Nulls, texts of fewer characters and null keys are in no list.

    parts: into how many a list is cut; by default by the number of rows.
    """
    rows = texts.select(F.col(key).alias("key"), F.lower(text).alias("text")).filter("key is not null and text is not null")
    parts = parts or max(1, round(rows.count() / PART_KEYS))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int")).repartition("part")  # so that a task's texts share their parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.sort_by("part")
            sizes = pc.utf8_length(batch.column(1)).to_numpy()
            piece = np.cumsum(sizes) // PIECE_CHARS
            for some in (batch.slice(a, b - a) for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows])):
                gram, owner = gram_owners(some.column(1).to_pylist())
                part = some.column(2).to_numpy()[owner]
                first = np.flatnonzero(np.concatenate([[True], (gram[1:] != gram[:-1]) | (part[1:] != part[:-1])])) if len(gram) else np.zeros(0, np.int64)
                ends = pa.array(np.append(first, len(gram)).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, some.column(0).take(pa.array(owner)))
                yield pa.RecordBatch.from_arrays([pa.array(gram_strings(gram[first]), pa.string()), pa.array(part[first]), lists], ["gram", "part", "some"])

    found = dealt.mapInArrow(run, f"gram string, part int, some array<{rows.schema['key'].dataType.simpleString()}>")
    lists = found.groupBy("gram", "part").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("some")))).alias("keys"))
    return keep(lists.repartitionByRange("gram", "part").sortWithinPartitions("gram", "part"), "gram-index")


def candidates(index: DataFrame, token: str) -> DataFrame:
    """key of the texts that hold all grams of a token of three characters or more; texts that hold the token are among them."""
    grams = grams_of(token)
    if not grams:
        raise ValueError(f"a token of fewer than {GRAM} characters has no grams")
    lists = index.filter(F.col("gram").isin(grams)).groupBy("part").agg(F.collect_list("keys").alias("lists")).filter(F.size("lists") == len(grams))
    by_size = F.array_sort("lists", lambda a, b: F.size(a) - F.size(b))  # the shortest first
    common = F.aggregate(F.slice(by_size, 2, len(grams)), by_size[0], lambda out, other: F.array_intersect(out, other))
    return lists.select(F.explode(common).alias("key"))


def matches(index: DataFrame, texts: DataFrame, key: str, text: str, token: str) -> DataFrame:
    """The rows of texts whose text holds the token, whatever the letter case: candidates of the index verified; a shorter token reads all texts, an empty one matches every text. Rows without a key match nothing."""
    rows = texts.filter(F.col(key).isNotNull())
    token = texts.sparkSession.range(1).select(F.lower(F.lit(token))).first()[0]  # lower-cased as the texts are
    if len(token) >= GRAM:
        rows = rows.join(candidates(index, token).withColumnRenamed("key", key), key, "left_semi")
    return rows.filter(F.contains(F.lower(text), F.lit(token)))
