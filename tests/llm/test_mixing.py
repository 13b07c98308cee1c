"""The mix against a plain version of the targets, its budget, and the edge cases."""

import re
from collections import Counter, defaultdict

from docketspark.llm import mixing
from docketspark.llm.queries import op1_mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes):
    """Sharing round by round: sources above their limit stop there, the rest is shared anew."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not full:
            out |= {s: unit * weight[s] for s in open_}
            break
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


def check(rows, docs):
    """rows: doc_id, size, source_size, target, taken; docs: (doc_id, text, source)."""
    sizes, of = defaultdict(int), {}
    for d, t, s in docs:
        sizes[s] += len(WORD.findall(t or ""))
        of[d] = s
    want = plain_targets(sizes)
    taken, largest = Counter(), Counter()
    assert len(rows) == len(docs)
    for r in rows:
        s = of[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - want[s]) <= 1e-6 * max(1, want[s])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[s] += r.taken
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * largest[s] + 1
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())


def test_query(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = op1_mixing(spark, sf_dir).collect()
    assert {r.doc_id: r.size for r in rows} == {d: len(WORD.findall(t or "")) for d, t, _ in docs}
    check(rows, docs)
    assert {tuple(r) for r in rows} == {tuple(r) for r in op1_mixing(spark, sf_dir).collect()}


def test_mixed_documents_agree_with_the_mixture(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    copies = {r.doc_id: r.copies for r in mixing.mixture(docs).collect() if r.copies}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.select("doc_id").collect()) == Counter(copies)


def test_edge_cases(spark):
    hot = [(i, "w " * (1 + i % 7), "hot") for i in range(400)]
    rows = hot + [(1000 + i, "a b c", f"s{i % 4}") for i in range(40)] + [(2000, None, "empty"), (2001, "", "empty"), (2002, " \n", None), (2003, "long " * 30000, None)]
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "doc_id long, text string, source string, size int, T int, cut int")
    check(mixing.mixture(docs).collect(), rows)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and out.filter("doc_id in (2000, 2001, 2002)").count() == 0
    same = spark.createDataFrame([(None, "a b", "x")] * 5 + [(1, "c d e", "y")] * 3, "doc_id long, text string, source string")
    got = mixing.mixture(same).collect()
    assert len(got) == 8 and len({(r.doc_id, r.copies) for r in got}) == 2
    none = docs.limit(0)
    assert mixing.mixture(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    blank = docs.filter("doc_id = 2000")
    assert [tuple(r)[1:6] for r in mixing.mixture(blank).collect()] == [(0, 0, 0.0, 0, 0)]
