"""Held-out accuracy of the compression classifier, and its edge cases."""

import random
import zlib

import numpy as np

from docketspark.llm import quality_classifier as qc
from docketspark.llm.queries import op3_quality_classifier


def auc(y, score):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    ones = int(y.sum())
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    rows = op3_quality_classifier(spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(label[r.doc_id], r.score) for r in rows if r.held_out and r.doc_id in label]
    y, score = np.array([a for a, _ in held]), np.array([b for _, b in held])
    assert auc(y, score) > 0.98
    assert np.mean(score[y == 1] >= 0.3) > 0.98 and np.mean(score[y == 0] >= 0.3) < 0.15


def test_labels_of_the_held_out_fold_are_not_learnt(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.selectExpr("doc_id", "if(crc32(cast(string(doc_id) as binary)) % 5 = 0, 1 - quality, quality) as quality")
    assert qc.train(docs, labels) == qc.train(docs, turned)


def test_prior_needs_a_clear_gain():
    rng = np.random.default_rng(1)
    y = np.tile([1.0, 1.0, 0.0, 1.0, 0.0, 0.0], 200)
    n = rng.integers(10, 60, len(y)).astype(float)
    # short texts whose difference is a number of bytes, whatever their size: the larger the prior, the better
    bad = n / 2 + np.where(y == 1, 4, -4) + rng.normal(0, 2, len(y))
    sizes = np.column_stack([n, n / 2, bad])
    assert qc.losses(sizes, y, 1024).sum() < qc.losses(sizes, y, 16).sum()
    assert qc.chosen_prior(sizes, y, (16, 1024)) in (16, 1024) and qc.chosen_prior(sizes[:0], y[:0]) == qc.PRIORS[0]
    noise = np.column_stack([n, n / 2, n / 2 + rng.normal(0, 1, len(y))])
    assert qc.chosen_prior(noise, rng.permutation(y), (64, 64, 64)) == 64


def test_edge_cases(spark):
    rng = random.Random(2)
    line = lambda end: " ".join("".join(rng.choices("aeioulnrst", k=rng.randint(2, 9))) + end for _ in range(rng.randint(40, 200)))
    rows = [(i, line("")) for i in range(60)] + [(100 + i, line("!!##")) for i in range(60)]
    odd = [(None, None), (200, ""), (200, ""), (201, "x"), (202, "long text " * 60000)]
    docs = spark.createDataFrame([(*r, 5, 6) for r in rows + odd], "doc_id long, text string, score int, Y int")
    labels = spark.createDataFrame([(d, int(d < 100)) for d, _ in rows] + [(None, 1), (1, 0), (2, None), (200, 1)], "doc_id long, quality int")
    model = qc.train(docs, labels)
    out = qc.scored(docs, model, out="s").collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r.s <= 1 for r in out)
    got = [(r.doc_id < 100, r.s) for r in out if r.doc_id is not None and r.doc_id < 200]
    assert auc(np.array([int(y) for y, _ in got]), np.array([x for _, x in got])) > 0.95
    nothing = qc.train(docs, labels.limit(0))
    assert {r.s for r in qc.scored(docs, nothing, out="s").collect()} == {0.5}
    assert qc.scored(docs.limit(0), model).count() == 0 and qc.train(docs.limit(0), labels).good == b""
