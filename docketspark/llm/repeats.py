"""Removal of long repeated passages by distributed prefix doubling over sampled positions.

A suffix sort of every byte would shuffle each of them in every round. Here only anchors are sorted: of each string of LENGTH bytes the first of the
k-grams with the smallest hash in it, so that equal strings have their anchor at the same offset, and about one position in a hundred is one. An anchor
answers for the consecutive strings that have it (its range). In the first round anchors get the rank of their k bytes; the strings
of an anchor whose rank nobody shares occur once. In later rounds the ranges are cut into narrower cells of offsets from the
anchor, so that the prefix that all strings of a cell share grows towards LENGTH, and (cell, prefix) is ranked anew:

- a cell whose prefix nobody shares holds no repeated string and goes;
- cells of the same whole span (from the first string's start to the last one's end) repeat each other throughout: their bytes are covered,
  and one of them stays behind to be met by others;
- a cell goes on only while its rank has different spans and one of them is open.

The last round's cells are single strings, so the answer is exact but for collisions of two independent 64-bit hashes. Ranks are
counted by grouping; no group of equal strings is gathered, no pairs are made. Texts are read again only where something was shared.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SpanHasher, discard, materialize, mix64, numbered, rows_of, small

LENGTH = 400
#: The widths of cells, in offsets, of the rounds after the first; the last is a single string.
WIDTHS = (17, 1)
#: Bytes of a buffer that are hashed together; a place fits in the low bits of a hash.
BLOCK, PLACE = 1 << 19, np.uint64((1 << 24) - 1)


def gram(length: int) -> int:
    """Bytes of the k-grams among which the anchors are chosen, about a third of the strings' length."""
    return max(1, length * 8 // 25)


def _first_smallest(data: np.ndarray, length: int) -> np.ndarray:
    """For each string of `length` bytes in data, the place of the first of its k-grams with the smallest hash."""
    k = gram(length)
    hashed = SpanHasher(data)
    values = mix64((hashed.prefix[k:] - hashed.prefix[:-k]) * hashed.inverse[: len(data) - k + 1])
    least = (values & ~PLACE) | np.arange(len(values), dtype=np.uint64)
    width, wide = length - k + 1, 1
    while 2 * wide <= width:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < width:
        least = np.minimum(least[: len(least) - (width - wide)], least[width - wide :])
    return (least & PLACE).astype(np.int64)


def anchors(buffer: bytes, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): the anchors of all strings of texts in a buffer, and the starts of the first and the last string that have them."""
    data, found = np.frombuffer(buffer, dtype=np.uint8), []
    for at in range(0, max(len(data) - length + 1, 0), BLOCK):
        block = data[at : at + BLOCK + length - 1]
        # strings that begin here and end within their text
        marks = np.zeros(len(block) - length + 2, dtype=np.int32)
        first, end = np.clip(starts - at, 0, len(marks) - 1), np.clip(ends - length + 1 - at, 0, len(marks) - 1)
        whole = end > first
        np.add.at(marks, first[whole], 1)
        np.add.at(marks, end[whole], -1)
        begin = np.flatnonzero(np.cumsum(marks[:-1]))
        if len(begin):
            anchor = _first_smallest(block, length)[begin]
            cut = np.flatnonzero(anchor[1:] != anchor[:-1])
            found.append((anchor[np.append(cut, len(anchor) - 1)] + at, begin[np.append(0, cut + 1)] + at, begin[np.append(cut, len(begin) - 1)] + at))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    anchor, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    new = np.append(True, anchor[1:] != anchor[:-1])  # a range that goes on in the next block is one
    ending = np.append(new[1:], True)
    return anchor[new], first[new], last[ending]


def _longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _keyed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id, h (with it, a document's name; rows that agree in both are alike) and the text's bytes."""
    whole = F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("h"), whole.alias("text"))


def _same(a: str, b: str, h: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b)) & (F.col("h") == F.col(h))


def _anchored(keyed: DataFrame, length: int) -> DataFrame:
    """The first round's places: doc_id, h, a, near and far (the range, as offsets of the anchor in its last and first string), prefix, span."""
    k = gram(length)

    def run(batches):
        for part, texts in rows_of(batches):
            buffer = b"".join(texts)
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            ends = np.cumsum(sizes)
            anchor, first, last = anchors(buffer, ends - sizes, ends, length)
            owner = np.searchsorted(ends, anchor, side="right")
            rows = zip(anchor.tolist(), first.tolist(), last.tolist(), strict=True)
            ranks = [(xxhash.xxh3_64_intdigest(buffer[a : a + k]), xxhash.xxh3_64_intdigest(buffer[i : j + length], a - i + 1)) for a, i, j in rows]
            taken = part.select([0, 1]).take(pa.array(owner))
            prefix, span = (_longs([r[n] for r in ranks]) for n in (0, 1))
            places = [pa.array(x.astype(np.int32)) for x in (anchor - (ends - sizes)[owner], anchor - last, anchor - first)]
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), *places, prefix, span], ["doc_id", "h", "a", "near", "far", "prefix", "span"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.filter(F.length("text") >= length).mapInArrow(run, f"doc_id {kind}, h long, a int, near int, far int, prefix long, span long").withColumn("open", F.lit(True))


def _cells(near: int, far: int, width: int, first: bool, most: int):
    """The cells of offsets that a range is cut into; in the first cut they lie on one grid for all anchors."""
    base = near // width * width if first else near
    for low in range(base, far + 1, width):
        yield low, min(low + width - 1, most if first else far)


def _cut(held: DataFrame, length: int, width: int, first: bool) -> DataFrame:
    """The places of a round: the cells of each document's tasks with their ranks. held: doc_id, h, text, tasks (a, near, far, open)."""
    most, digest = length - gram(length), xxhash.xxh3_64_intdigest

    def run(batches):
        for part, texts in rows_of(batches, "text"):
            row, out = [], []
            for r, (text, tasks) in enumerate(zip(texts, part.column(3).to_pylist(), strict=True)):
                n = len(text)
                for task in tasks or ():
                    a = task["a"]
                    for near, far in _cells(task["near"], task["far"], width, first, most):
                        if a < near or a - far + length > n:
                            continue  # none of the cell's strings lies in the text
                        prefix = digest(text[a - near : a - far + length], 2 * (near * length + far))
                        if a < far or a - near + length > n:
                            span = digest(f"{part.column(1)[r]} {part.column(0)[r]} {a}", 2 * near + 1)  # its own
                        else:
                            span = digest(text[a - far : a - near + length], 2 * (near * length + far) + 1)
                        row.append(r)
                        out.append((a, near, far, prefix, span, task["open"]))
            a, near, far, prefix, span, open_ = zip(*out, strict=True) if out else ((),) * 6
            taken = part.select([0, 1]).take(pa.array(row, pa.int64()))
            places = [pa.array(x, pa.int32()) for x in (a, near, far)]
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), *places, _longs(prefix), _longs(span), pa.array(open_, pa.bool_())], ["doc_id", "h", "a", "near", "far", "prefix", "span", "open"])

    kind = held.schema["doc_id"].dataType.simpleString()
    return held.select("doc_id", "h", "text", "tasks").mapInArrow(run, f"doc_id {kind}, h long, a int, near int, far int, prefix long, span long, open boolean")


def _ranked(places: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """A round: the covered spans (doc_id, h, start, end), and the places that go on (doc_id, h, a, near, far, open)."""
    places = materialize(places, "repeats-places")
    shared = materialize(places.groupBy("prefix").agg(F.count("*").alias("n")).filter("n > 1").select("prefix"), "repeats-shared")
    live = materialize(places.join(shared, "prefix"), "repeats-live")
    discard(places, shared)
    first = F.min(F.struct("doc_id", "h", "a", "near", "far")).alias("one")
    spans = materialize(live.groupBy("prefix", "span").agg(F.count("*").alias("n"), F.max("open").alias("open"), first), "repeats-spans")
    twice = materialize(spans.filter("n > 1 AND open").select("prefix", "span"), "repeats-twice")
    covered = live.filter("open").join(twice, ["prefix", "span"]).select("doc_id", "h", (F.col("a") - F.col("far")).alias("start"), (F.col("a") - F.col("near") + length).alias("end"))
    covered = materialize(covered, "repeats-covered")
    discard(live, twice)
    alone = F.col("open") & (F.col("n") == 1)
    classes = spans.groupBy("prefix").agg(F.count("*").alias("spans"), F.max(alone).alias("asked")).filter("spans > 1 AND asked").select("prefix")
    classes = materialize(classes, "repeats-classes")
    going = materialize(spans.join(classes, "prefix").select("one.*", alone.alias("open")), "repeats-going")
    discard(spans, classes)
    return covered, going


def _grouped(going: DataFrame) -> DataFrame:
    return going.groupBy("doc_id", "h").agg(F.collect_list(F.struct("a", "near", "far", "open")).alias("tasks"))


def _joined(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal spans of spans in any order; those that touch are one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((s["start"], s["end"]) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in spans)]
    return b"".join(text[a:b] for a, b in zip(ends, [*(s for s, _ in spans), len(text)], strict=True))


def repeated_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """doc_id, h, spans (start, end; maximal, in order) and kept_sha256 of the documents with bytes in strings of `length` bytes that also start elsewhere.

    h is the text's xxhash64; rows that agree in doc_id and h are alike (and repeat each other) and come once. Nulls count as empty; texts
    shorter than `length` repeat nothing; an empty table gives no rows.
    """
    docs, (text, doc_id) = numbered(docs, text, doc_id)
    keyed = _keyed(docs, text, doc_id)
    covered, going = _ranked(_anchored(keyed, length), length)
    # the texts of all documents in question are dealt once, with their first tasks
    asked = covered.select("doc_id", "h").distinct().withColumn("tasks", F.lit(None).cast("array<struct<a:int,near:int,far:int,open:boolean>>"))
    asked = _grouped(going).unionByName(asked).groupBy("doc_id", "h").agg(F.first("tasks", ignorenulls=True).alias("tasks"))
    asked = materialize(asked.select(F.col("doc_id").alias("asked_id"), F.col("h").alias("asked_h"), "tasks"), "repeats-asked")
    held = keyed.filter(F.length("text") >= length).join(asked, _same("doc_id", "asked_id", "asked_h"))
    texts, parts = materialize(held.select("doc_id", "h", "text", "tasks"), "repeats-texts"), [covered]
    held = texts
    for turn, width in enumerate(WIDTHS):
        if turn:
            tasks = materialize(_grouped(going).select(F.col("doc_id").alias("asked_id"), F.col("h").alias("asked_h"), "tasks"), "repeats-tasks")
            held = texts.drop("tasks").join(tasks, _same("doc_id", "asked_id", "asked_h"))
        covered, going = _ranked(_cut(held, length, width, not turn), length)
        parts.append(covered)
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    # a document's spans are no more than its bytes
    found = every.distinct().groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    found = materialize(found.select(F.col("doc_id").alias("asked_id"), F.col("h").alias("asked_h"), "spans"), "repeats-found")

    def run(batches):
        for part, bodies in rows_of(batches):
            joined = [_joined(s) for s in part.column(3).to_pylist()]
            ends = np.cumsum([0, *map(len, joined)]).astype(np.int32)
            flat = np.array([x for spans in joined for x in spans], dtype=np.int32).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"]))
            digests = [hashlib.sha256(_without(t, s)).hexdigest() for t, s in zip(bodies, joined, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, pa.array(digests)], ["doc_id", "h", "spans", "kept_sha256"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    found = texts.join(found, _same("doc_id", "asked_id", "asked_h")).select("doc_id", "h", "text", "spans")
    found = found.mapInArrow(run, f"doc_id {kind}, h long, spans array<struct<start:int,end:int>>, kept_sha256 string")
    out = materialize(found.dropDuplicates(["doc_id", "h"]), "repeats-spans-found")
    discard(*parts, going, asked, texts)
    return out


def removals(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 (of the bytes left) of every row. Nulls, short texts and repeats are as in repeated_spans()."""
    found = repeated_spans(docs, text, doc_id, length).select(F.col("doc_id").alias("found_id"), F.col("h").alias("found_h"), "spans", F.col("kept_sha256").alias("kept"))
    sizes = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    found = found.select("found_id", "found_h", sizes.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept")
    docs, (text, doc_id) = numbered(docs, text, doc_id)
    every = _keyed(docs, text, doc_id).select("doc_id", "h", F.length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    every = every.join(small(found), _same("doc_id", "found_id", "found_h"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.select("doc_id", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """docs with their texts less the repeated bytes; parts of characters at the cuts go too. Texts without any, null ones too, stay as they are."""
    found = repeated_spans(docs, text, doc_id, length).select(F.col("doc_id").alias("found_id"), F.col("h").alias("found_h"), "spans")
    names = docs.columns
    docs, (text, doc_id) = numbered(docs, text, doc_id)
    columns, place = docs.columns, docs.columns.index(text)
    joined = docs.withColumn("h", F.xxhash64(F.col(text).cast("binary"))).join(small(found), _same(doc_id, "found_id", "found_h"), "left").select(*columns, "spans")

    def run(batches):
        for part, bodies in rows_of(batches, text):
            spans = part.column(len(columns)).to_pylist()
            cut = [t if s is None else _without(t.encode(), [(x["start"], x["end"]) for x in s]).decode(errors="ignore") for t, s in zip(bodies, spans, strict=True)]
            left = pa.array(cut, pa.string(), mask=np.array(part.column(place).is_null()))
            yield pa.RecordBatch.from_arrays([left if i == place else part.column(i) for i in range(len(columns))], columns)

    return joined.mapInArrow(run, docs.schema).toDF(*names)


#: DuckDB: the digests of all windows of 400 bytes, as hexadecimal digits.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents
), c AS (
  SELECT row, j, substr(t, 2000 * j + 1, 2798) AS t FROM d, range((length(t) // 2 + 600) // 1000) r(j)
), p AS (
  SELECT row, 1000 * j + i AS i, md5(substr(t, 2 * i + 1, 800)) AS s FROM c, range(length(t) // 2 - 399) r(i)
), again AS (
  SELECT s FROM p GROUP BY s HAVING count(*) > 1
), starts AS (
  SELECT row, i, i - lag(i) OVER (PARTITION BY row ORDER BY i) AS gap FROM p SEMI JOIN again USING (s)
), runs AS (
  SELECT row, i, sum((coalesce(gap, 401) > 400)::INT) OVER (PARTITION BY row ORDER BY i) AS run FROM starts
), spans AS (
  SELECT row, run, min(i) AS b, max(i) + 400 AS e FROM runs GROUP BY ALL
), gaps AS (
  SELECT row, b, e, lead(b) OVER (PARTITION BY row ORDER BY b) AS next, row_number() OVER (PARTITION BY row ORDER BY b) AS nth FROM spans
), kept AS (
  SELECT d.row, count(*) AS n_spans, sum(e - b) AS n_removed,
    string_agg(if(nth = 1, substr(t, 1, 2 * b), '') || substr(t, 2 * e + 1, 2 * (coalesce(next, length(t) // 2) - e)), '' ORDER BY b) AS rest
  FROM gaps JOIN d USING (row) GROUP BY ALL
)
SELECT doc_id, length(t) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, t))) AS kept_sha256
FROM d LEFT JOIN kept USING (row)
"""
