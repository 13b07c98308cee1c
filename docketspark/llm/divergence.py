"""How each source's terms diverge from its language's and from the other sources': sorted runs, scanned once.

Tasks count the terms of a few MB of documents per language and source; these posting rows are dealt by (lang, term) and sorted by
(lang, term, source, document) in their partitions, and one scan over the run of a term gives its document frequency and counts, with a run and a
batch in memory. A frequent term has a row per counting task and source, never one per document. Languages' term numbers and sources'
totals follow from the runs kept. A second scan goes over the runs in buckets of a language, so that a
large language is many tasks, and gives the bucket's part of every pair's sum and its first terms of every source.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, numbered, rows_of

#: Documents of a language that a term must occur in, the scale of shares, and how many terms a source reports.
MIN_DOCUMENTS = 3
SCALE_THOUSANDS = 3  # shares are of 1000^3
TOP = 200
#: Distinct (source, term) counts that a task holds before it gives them out, rows of a scan step, and kept terms of a bucket (16 a source at least).
HELD, STEP, BUCKET = 400_000, 50_000, 2_000
#: Shares times pairs of sources that are worked on at a time.
CELLS = 4 << 20

#: Every byte that is part of a term stands for itself, capitals for small letters, all others for a space; bytes from 0x80 belong to terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The runs of letters and of characters beyond ASCII, A-Z lower-cased."""
    return text.translate(_LETTERS).split()


def shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(1000^3 (count + 1) / (total + kept)), exactly: three decimal digits at a time, so totals up to 9 * 10^15 fit."""
    whole = (total + kept).astype(np.int64)
    rest = counts.astype(np.int64) + 1
    out = np.zeros(np.broadcast_shapes(rest.shape, whole.shape), dtype=np.int64)
    for _ in range(SCALE_THOUSANDS):
        digits, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + digits
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q) of shares; squares stay below 2^63."""
    return (p - q) * (p - q) // q


def postings(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """lang, term, source, document (the first row number in its task), df and count: terms of consecutive documents of a task, counted together.

    Nulls count as empty strings. Every row of docs is a document of its own.
    """
    docs, (text, lang, source) = numbered(docs, text, lang, source)
    rows = docs.select(F.coalesce(lang, F.lit("")).alias("lang"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).cast("binary").alias("text"))

    def given(held: dict, first: int):
        for (lang, source), (count, df) in held.items():
            n, terms = len(count), list(count)
            columns = [pa.array([lang] * n), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([source] * n), pa.array(np.full(n, first)), pa.array([df[t] for t in terms], pa.int64()), pa.array(list(count.values()), pa.int64())]
            whole = pa.RecordBatch.from_arrays(columns, ["lang", "term", "source", "document", "df", "count"])
            for at in range(0, n, STEP):
                yield whole.slice(at, STEP)

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        first, seen = 0, 0
        for part, texts in rows_of(batches):
            for lang, source, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                terms = terms_of(text)
                count, df = held.setdefault((lang, source), (Counter(), Counter()))
                count.update(terms)
                df.update(set(terms))
                seen += 1
            if sum(len(count) for count, _ in held.values()) > HELD:
                yield from given(held, first)
                held, first = {}, seen
        yield from given(held, first)

    return rows.mapInArrow(run, "lang string, term string, source string, document long, df long, count long")


def _starts(table: pa.Table, names: list[str]) -> np.ndarray:
    """Where a run of equal values in the columns begins."""
    n = table.num_rows
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for name in names:
        c = table.column(name)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, max(n - 1, 0))).to_numpy()
    return np.flatnonzero(new)


def kept_terms(rows: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, term, df, count (both in the language), sources and counts (by source) of the terms in at least min_documents documents.

    rows: as postings(). Terms of a language are dealt by hash; a partition is scanned in its sorted order.
    """
    ordered = rows.repartition("lang", "term").sortWithinPartitions("lang", "term", "source", "document")

    def run(batches):
        open_: list[pa.RecordBatch] = []
        for batch in batches:
            open_.append(batch)
            if sum(b.num_rows for b in open_) < STEP:
                continue
            table = summed(pa.Table.from_batches(open_))
            last = table.num_rows - 1
            tail = last
            lang, term = table.column("lang"), table.column("term")
            while tail and lang[tail - 1].as_py() == lang[last].as_py() and term[tail - 1].as_py() == term[last].as_py():
                tail -= 1  # the term's sources so far: at most one row each
            yield from closed(table.slice(0, tail))
            open_ = table.slice(tail).to_batches()
        if open_:
            yield from closed(summed(pa.Table.from_batches(open_)))

    def summed(table: pa.Table) -> pa.Table:
        """One row per (lang, term, source) of sorted rows."""
        table = table.combine_chunks()
        at = _starts(table, ["lang", "term", "source"])
        sums = [np.add.reduceat(table.column(c).to_numpy(), at) for c in ("df", "count")]
        return pa.table([*(table.column(i).take(pa.array(at)) for i in range(3)), table.column("document").take(pa.array(at)), *map(pa.array, sums)], names=table.column_names)

    def closed(table: pa.Table):
        if not table.num_rows:
            return
        at = _starts(table, ["lang", "term"])
        df, count = (np.add.reduceat(table.column(c).to_numpy(), at) for c in ("df", "count"))
        ends = pa.array(np.append(at, table.num_rows).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, table.column(c).combine_chunks()) for c in ("source", "count")]
        out = pa.table([table.column(0).take(pa.array(at)), table.column(1).take(pa.array(at)), pa.array(df), pa.array(count), *lists], names=["lang", "term", "df", "count", "sources", "counts"])
        yield from out.filter(pa.array(df >= min_documents)).combine_chunks().to_batches()

    return ordered.mapInArrow(run, "lang string, term string, df long, count long, sources array<string>, counts array<long>")


def _bucket_parts(top: int):
    """The scan over one bucket of a language's kept terms: parts of the pairs' sums, and each source's first terms."""

    def run(runs: pa.Table, groups: pa.Table) -> pa.Table:
        lang = groups.column("lang")[0].as_py()
        order = np.argsort(np.array(groups.column("source").to_pylist(), dtype=object))
        names = groups.column("source").take(pa.array(order))
        totals = groups.column("n").to_numpy()[order]
        kept, whole = groups.column("kept")[0].as_py(), groups.column("whole")[0].as_py()
        place, n, size = {s: i for i, s in enumerate(names.to_pylist())}, runs.num_rows, len(order)
        sums = np.zeros((size, size), dtype=np.int64)
        first: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        step = max(1, CELLS // (size * size))
        for at in range(0, n, step):
            part = runs.slice(at, step)
            lists = part.column("sources").combine_chunks()
            row = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy())
            col = np.fromiter((place[s] for s in lists.flatten().to_pylist()), np.int64)
            counts = np.zeros((part.num_rows, size), dtype=np.int64)
            counts[row, col] = part.column("counts").combine_chunks().flatten().to_numpy()
            p = shares(counts, totals[None, :], kept)
            for i in range(size):
                sums[i] += divergence(p[:, i : i + 1], p).sum(axis=0)
            q = shares(part.column("count").to_numpy(), np.int64(whole), kept)
            high = p[row, col] > q[row]
            first.append((at + row[high], col[high], divergence(p[row, col], q[row])[high]))
        i, j = np.nonzero(~np.eye(size, dtype=bool))
        out = [pa.table([names.take(pa.array(i)), pa.array(["pair"] * len(i), pa.string()), names.take(pa.array(j)), pa.array(sums[i, j])], names=["source", "part", "item", "value"])]
        if n:
            row, col, value = (np.concatenate(x) for x in zip(*first, strict=True))
            terms = runs.column("term").to_pylist()
            spelt = np.empty(n, dtype=np.int64)
            spelt[sorted(range(n), key=lambda k: terms[k].encode())] = np.arange(n)
            best = np.lexsort([spelt[row], -value, col])
            row, col, value = row[best], col[best], value[best]
            starts = np.flatnonzero(np.append(True, col[1:] != col[:-1])[: len(col)])
            rank = np.arange(len(col)) - np.repeat(starts, np.diff(np.append(starts, len(col))))
            row, col, value = row[rank < top], col[rank < top], value[rank < top]
            out.append(pa.table([names.take(pa.array(col)), pa.array(["term"] * len(col), pa.string()), runs.column("term").take(pa.array(row)), pa.array(value)], names=["source", "part", "item", "value"]))
        both = pa.concat_tables([t.cast(pa.schema([("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])) for t in out])
        return both.add_column(0, "lang", pa.array([lang] * both.num_rows, pa.string()))

    return run


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` is the source's divergence from each other one of its language, part `term` its first terms.

    Each language keeps its terms in at least min_documents documents. With p = shares() of a source and q of another source (pair) or of the
    language (term), a pair's value is the sum of divergence() over all kept terms, zero counts included; terms are those that occur in the source with
    p > q. Ranks run from 1 by value, largest first, then by the item's UTF-8 bytes; terms up to `top`.
    Null text, lang and source count as empty strings, repeated rows are documents of their own. A source without terms takes part; without any
    kept term all pairs are 0. A language of one source has no pairs. An empty table gives no rows.
    """
    terms = materialize(kept_terms(postings(docs, text, lang, source), min_documents), "divergence-terms")
    renamed, (_, l, s) = numbered(docs, text, lang, source)
    groups = renamed.select(F.coalesce(l, F.lit("")).alias("lang"), F.coalesce(s, F.lit("")).alias("source")).distinct()
    totals = terms.select("lang", F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n")))).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("count").alias("whole"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    buckets = F.floor(zero("kept") / F.greatest(F.lit(BUCKET), 16 * F.col("sources"))) + 1
    langs = materialize(groups.groupBy("lang").agg(F.count("*").alias("sources")).join(langs, "lang", "left").select("lang", zero("kept"), zero("whole"), buckets.alias("buckets")), "divergence-langs")
    groups = materialize(groups.join(totals, ["lang", "source"], "left").join(langs, "lang").select("lang", "source", zero("n"), "kept", "whole", "buckets"), "divergence-groups")
    # each bucket of a language gets the language's groups
    every = groups.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("buckets") - 1))).drop("buckets")
    dealt = terms.join(langs.select("lang", "buckets"), "lang").withColumn("bucket", F.pmod(F.xxhash64("term"), "buckets")).drop("buckets", "df")
    parts = dealt.groupBy("lang", "bucket").cogroup(every.groupBy("lang", "bucket")).applyInArrow(_bucket_parts(top), "lang string, source string, part string, item string, value long")
    parts = materialize(parts, "divergence-parts")
    values = parts.groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return values.withColumn("rank", rank.cast("int")).filter((F.col("part") == "pair") | (F.col("rank") <= top))


#: DuckDB: all kept terms beside all pairs of sources.
SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), w AS (SELECT row, lang, source, unnest(terms) AS term FROM d
), k AS (SELECT lang, term, count(*) AS whole FROM w GROUP BY ALL HAVING count(DISTINCT row) >= 3
), c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL
), g AS (SELECT DISTINCT lang, source FROM d
), v AS (SELECT lang, count(*) AS v, sum(whole) AS n FROM k GROUP BY ALL
), t AS (SELECT lang, source, coalesce(sum(n), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL
), p AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.n + v.v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (k.whole + 1)) // (v.n + v.v)::HUGEINT AS q
  FROM t JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM o QUALIFY part = 'pair' OR rank <= 200
"""
