"""Neighbours against brute force: exact answers, the windows' recall, ties and vectors that take no part."""

import numpy as np
from pyspark.sql import functions as F

from docketspark.llm import ann
from docketspark.llm.queries import op7_ann


def brute(rows, queries, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], dtype=float)
    out = {}
    for q, v in queries:
        score = (x * np.array(v, dtype=float)).sum(axis=1)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), score[i]) for i in order]
    return out


def brute_with_self(rows, queries, k):
    """As brute(), a query's own id among the answers."""
    return {q: brute(rows, [(-1, v)], k)[-1] for q, v in queries}


def answers(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_hilbert_neighbours_differ_by_one_step():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = ann.hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def recall_of(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in want])


def test_recall_on_the_tables(spark):
    """Directions without any structure are the hardest case; 500 and 2000 vectors are 8 and 13 blocks."""
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
        got, want = answers(op7_ann(spark, sf)), brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
        assert recall_of(got, want) > 0.99 and all(len(x) == 20 for x in got.values())
        score = {q: dict(x) for q, x in brute(rows, [r for r in rows if r[0] % 20 == 0], len(rows)).items()}
        assert all(score[q][i] == s for q, x in got.items() for i, s in x)


def test_recall_with_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "MIN_BLOCK", 16)
    monkeypatch.setattr(ann, "BLOCK_SCALE", 0.9)  # 50 blocks of 40: a query meets 6 % of the vectors in an ordering
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    queries = vectors.filter("vec_id % 20 = 0")
    recall = {o: recall_of(answers(ann.nearest(vectors, queries, orderings=o)), want) for o in (4, 32)}
    assert recall[4] < recall[32] and recall[32] > 0.9


def test_rounds_go_on_until_the_recall_is_reached(spark, monkeypatch):
    """All 100 queries are measured here, so the recall is no estimate."""
    monkeypatch.setattr(ann, "MIN_BLOCK", 16)
    monkeypatch.setattr(ann, "BLOCK_SCALE", 0.9)
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in vectors.collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0], 20)
    queries = vectors.filter("vec_id % 20 = 0")
    recall = {share: recall_of(answers(ann.nearest(vectors, queries, recall=share)), want) for share in (0.5, 0.95)}
    assert 0.5 <= recall[0.5] < 0.95 <= recall[0.95]
    monkeypatch.setattr(ann, "LIMIT", 8)  # more orderings than that would be needed: all blocks are searched
    assert answers(ann.nearest(vectors, queries)) == want


def test_recall_is_measured_by_exact_answers(spark):
    rng = np.random.default_rng(9)
    rows = [(i, v.tolist()) for i, v in enumerate(np.round(rng.standard_normal((400, 8)), 1))]
    frame = spark.createDataFrame(rows + [(1000, rows[0][1])], "vec_id long, embedding array<double>")
    entries = ann.distinct_vectors(ann.one_each(ann.usable(frame)), 6)
    asked = ann.usable(frame).filter("vec_id % 100 = 0 and vec_id < 1000").select("v", F.col("vec_id").alias("rep"))
    exact = ann._exact(entries, asked, 6, 8, "<f8")
    got = {r.query_id: [(b.vec_id, -b.s) for b in r.best] for r in exact.collect()}
    assert got == brute_with_self(rows + [(1000, rows[0][1])], [rows[i] for i in (0, 100, 200, 300)], 6)
    assert ann._recall(exact, exact) == 1
    assert ann._recall(exact, exact.filter("query_id > 0")) < 0.8


def test_an_odd_smallest_vector_empties_nothing(spark):
    rng = np.random.default_rng(10)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((50, 4)), 1)]
    vectors = spark.createDataFrame([(0, [1.0]), *rows], "vec_id long, embedding array<double>")
    got = answers(ann.nearest(vectors, vectors.filter("vec_id % 10 = 0"), 5))
    assert got == brute(rows, [r for r in rows if r[0] % 10 == 0], 5)


def test_longest_inner_products_come_first(spark, monkeypatch):
    """Vectors of unequal lengths: the nearest by inner product are not those of the smallest angle."""
    monkeypatch.setattr(ann, "MIN_BLOCK", 32)
    monkeypatch.setattr(ann, "BLOCK_SCALE", 1.5)
    rng = np.random.default_rng(2)
    centers = rng.standard_normal((40, 24))
    x = np.repeat(centers, 50, axis=0) + 0.15 * rng.standard_normal((2000, 24))
    x *= rng.uniform(0.5, 1.5, (2000, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = answers(ann.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 10))
    assert recall_of(got, brute(rows, rows[::20], 10)) > 0.95


def test_many_copies_and_crowded_blocks(spark, monkeypatch):
    """A third of all rows is one vector, another third near copies of one; queries crowd in a block and are dealt over tasks."""
    monkeypatch.setattr(ann, "MIN_BLOCK", 16)
    monkeypatch.setattr(ann, "CROWD", 0.2)
    rng = np.random.default_rng(4)
    same, near = rng.standard_normal(16), rng.standard_normal(16)
    x = [same.tolist()] * 300 + [(near + 0.01 * rng.standard_normal(16)).tolist() for _ in range(300)] + rng.standard_normal((300, 16)).tolist()
    rows = list(enumerate(x))
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = answers(ann.nearest(vectors, vectors.filter("vec_id % 5 = 0"), 10)), brute(rows, rows[::5], 10)
    assert got.keys() == want.keys() and recall_of(got, want) > 0.95
    assert all(got[q] == want[q] for q in want if q < 300)


def test_edge_cases(spark):
    rng = np.random.default_rng(3)
    same = [1.0, 2.0, -1.0]
    rows = [(i, same) for i in range(0, 90)] + [(100 + i, rng.standard_normal(3).tolist()) for i in range(60)]
    bad = [(200, None), (220, [0.0, 0.0, 0.0]), (240, [1.0, None, 2.0]), (260, [float("nan"), 1.0, 1.0]), (280, [float("inf"), 1.0, 1.0]), (300, [1.0]), (320, []), (None, same)]
    vectors = spark.createDataFrame([(*r, 1, 2, 3) for r in rows + bad + rows[:2]], "vec_id long, embedding array<double>, keys int, V int, `a.b` int")
    queries = vectors.filter("vec_id % 20 = 0")
    assert answers(ann.nearest(vectors, queries, 5)) == brute(rows, [r for r in rows if r[0] % 20 == 0], 5)
    few = vectors.filter("vec_id in (0, 20, 100, 200)")
    assert answers(ann.nearest(few, few, 5)) == brute([r for r in rows if r[0] in (0, 20, 100)], [r for r in rows if r[0] in (0, 20, 100)], 5)
    assert ann.nearest(vectors.limit(0), queries, 5).count() == 0 and ann.nearest(vectors, queries.limit(0), 5).count() == 0
    assert ann.nearest(vectors.filter("vec_id = 200"), queries, 5).count() == 0
    one = vectors.filter("vec_id = 1").limit(1)
    assert ann.nearest(one, one, 5).count() == 0
    twice = spark.createDataFrame([(0, [2.0, 0.0]), (0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.5])], "vec_id long, embedding array<float>")
    assert answers(ann.nearest(twice, twice.filter("vec_id = 0"), 5)) == {0: [(1, 1.0), (2, -1.0)]}
