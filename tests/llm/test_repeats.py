"""Repeated passages against DuckDB, and against a dictionary of all windows for short strings, odd rows and texts of one letter."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from docketspark.llm import queries, repeats
from tests.compare import differences

LENGTH = 20


def plain(rows, length):
    """(doc_id, bytes, removed, spans, digest) of every row, from the counts of all windows."""
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        gone = np.zeros(len(t) + 1, dtype=bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.count_nonzero(gone[1:] < gone[:-1]))
        out.append((doc_id, len(t), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=False) if not g)).hexdigest()))
    return sorted(out, key=str)


def generated(seed):
    """Texts that share passages of many lengths at many places, whole or edited, with repeats inside and characters of several bytes."""
    rng = random.Random(seed)
    letters = "ab é€" if seed % 2 else "abcdefgh "
    fresh = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [fresh(rng.randrange(10, 120)) for _ in range(8)]
    rows = []
    for i in range(60):
        text = "".join(rng.choice([fresh(rng.randrange(40)), (p := rng.choice(passages))[rng.randrange(8) :], p, p[: rng.randrange(10, 60)]]) for _ in range(rng.randrange(5)))
        rows.append((i, text))
    return rows + [(60 + i, rows[i][1]) for i in range(5)] + [(100, (t := rows[7][1])[:30] + "#" + t[31:])]


ODD = [
    (1, None), (2, ""), (3, "short"), (None, "x" * 25), (4, "x" * LENGTH), (5, "ab" * 300), (6, "ab" * 40), (7, "0123456789" * 2), (7, "0123456789" * 2), (8, "\x00" * 21), (9, "é" * 11 + "end"),
    (10, "q" + "".join(map(str, range(1000)))), (10, "r" + "".join(map(str, range(1000)))), (11, "".join(map(str, range(1000))) + "e"),
]


def rows(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def table(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string")


def test_query_equals_sql(spark, sf_dir):
    assert differences(spark, sf_dir, ["op12_suffix_dedup"], queries.queries(), queries.oracle_sql())["op12_suffix_dedup"][0] == "same"


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_generated_passages(spark, seed):
    data = generated(seed)
    assert rows(repeats.removals(table(spark, data), length=LENGTH)) == plain(data, LENGTH)


def test_more_rounds_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(repeats, "WIDTHS", (7, 3, 1))
    monkeypatch.setattr(repeats, "BLOCK", 16)
    data = generated(4)
    assert rows(repeats.removals(table(spark, data), length=LENGTH)) == plain(data, LENGTH)


def test_odd_rows(spark):
    assert rows(repeats.removals(table(spark, ODD), length=LENGTH)) == plain(ODD, LENGTH)


def test_empty_table_and_clashing_columns(spark):
    docs = table(spark, ODD)
    assert repeats.removals(docs.limit(0), length=LENGTH).count() == 0
    odd = docs.selectExpr("1 AS h", "*", "2 AS Text", "3 AS spans", "4 AS a", "5 AS `a.b`")
    assert rows(repeats.removals(odd, length=LENGTH)) == plain(ODD, LENGTH)
    cut = repeats.without_repeats(odd, length=LENGTH)
    assert cut.columns == odd.columns
    left = {(r.doc_id, r[2]) for r in cut.collect()}
    assert {(1, None), (2, ""), (3, "short"), (None, ""), (4, ""), (10, "q"), (10, "r"), (11, "e"), (9, "end")} <= left


def test_anchors_answer_for_every_string():
    rng = np.random.default_rng(1)
    buffer = rng.integers(97, 100, 3000).astype(np.uint8).tobytes()
    ends = np.array([5, 1400, 1400, 3000])
    starts = np.array([0, 5, 1400, 1400])
    anchor, first, last = repeats.anchors(buffer, starts, ends, 100)
    assert [p for a, b in zip(first, last, strict=True) for p in range(a, b + 1)] == [*range(5, 1301), *range(1400, 2901)]
    assert all(b <= a <= f + 100 - repeats.gram(100) for a, f, b in zip(anchor, first, last, strict=True))
    assert len(anchor) < 120
