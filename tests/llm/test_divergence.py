"""Source divergence against DuckDB and a plain version with whole-number arithmetic."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from docketspark.llm import divergence, queries
from tests.compare import differences

ROWS = [
    ("the cat THE naïve", "en", "a"), ("The dog, the cat-fish", "en", "b"), ("the cat 12 naïve_naïve", "en", "a"), ("a a a the cat", "en", None), ("dog dog dog dog", "en", "b"), ("dog\x00cat", "en", "z"),
    (None, "en", "c"), ("", "fr", "a"), ("été été", "fr", "b"), ("été", None, "a"), ("été", None, "b"), ("été È", "", "b"), ("solo", "de", "only"), ("the cat THE naïve", "en", "a"), ("word " * 60_000, "en", "long"),
]


def plain(rows, top=200):
    """The rows of the result, with Python's integers and all counts held."""
    term = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
    capitals = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(lang or "", source or "", Counter(term.findall((text or "").translate(capitals)))) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df, counts = Counter(), defaultdict(Counter)
        for at, source, terms in docs:
            if at == lang:
                df.update(set(terms))
                counts[source].update(terms)
        kept = sorted((t for t in df if df[t] >= 3), key=lambda t: t.encode())
        whole = sum((counts[s] for s in counts), Counter())
        share = lambda c: [1 + 10**9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept]
        p, q = {s: share(counts[s]) for s in counts}, share(whole)
        for s in counts:
            pairs = [(-sum((x - y) ** 2 // y for x, y in zip(p[s], p[o], strict=True)), o.encode(), o) for o in counts if o != s]
            terms = [(-((x - y) ** 2 // y), t.encode(), t) for x, y, t in zip(p[s], q, kept, strict=True) if x > y and counts[s][t]]
            out |= {(lang, s, part, item, -value, rank + 1) for part, found in (("pair", pairs), ("term", sorted(terms)[:top])) for rank, (value, _, item) in enumerate(sorted(found))}
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "text string, lang string, source string")


def rows(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def test_query_equals_sql(spark, sf_dir):
    assert differences(spark, sf_dir, ["op13_source_divergence"], queries.queries(), queries.oracle_sql())["op13_source_divergence"][0] == "same"


def test_odd_rows(docs):
    assert rows(divergence.source_divergence(docs)) == sorted(plain(ROWS))
    assert rows(divergence.source_divergence(docs, top=1)) == sorted(plain(ROWS, 1))


def test_many_flushes_steps_and_buckets(spark, docs, monkeypatch, sf_dir):
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source")
    want = rows(divergence.source_divergence(texts))
    for name, value in (("HELD", 50), ("STEP", 7), ("BUCKET", 3), ("CELLS", 900)):
        monkeypatch.setattr(divergence, name, value)
    assert rows(divergence.source_divergence(docs)) == sorted(plain(ROWS))
    monkeypatch.setattr(divergence, "BUCKET", 60)
    monkeypatch.setattr(divergence, "STEP", 500)
    assert rows(divergence.source_divergence(texts)) == want


def test_empty_table_and_clashing_columns(docs):
    assert divergence.source_divergence(docs.limit(0)).count() == 0
    odd = docs.selectExpr("1 AS term", "2 AS Text", "*", "3 AS df", "4 AS bucket", "5 AS `a.b`")
    assert rows(divergence.source_divergence(odd)) == rows(divergence.source_divergence(docs))


def test_shares_are_exact_for_large_counts():
    rng = np.random.default_rng(5)
    total = rng.integers(1, 9 * 10**15, 500)
    count = (total * rng.random(500)).astype(np.int64)
    assert divergence.shares(count, total, 7).tolist() == [1 + 10**9 * (c + 1) // (n + 7) for c, n in zip(count.tolist(), total.tolist(), strict=True)]
