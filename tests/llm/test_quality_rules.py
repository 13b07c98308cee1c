"""Counts against a brute-force version, verdicts against labels and planted outliers, edge cases."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from docketspark.llm import quality_rules as rules
from docketspark.llm.queries import op2_quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, rep, n < 20 or 100 * rep > 30 * n


def test_query_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    got = {r.doc_id: tuple(r)[1:7] for r in op2_quality_rules(spark, sf_dir).collect()}
    assert got == {r.doc_id: brute(r.text) for r in docs}


def test_verdicts_follow_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    out = op2_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    share = {r.quality: r.share for r in out.filter("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("share")).collect()}
    assert share[1] > 0.98 and share[0] < 0.1


def test_edge_cases(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "and", "house", "river", "stone"]
    clean = [" ".join(rng.choice(words) + str(rng.choice(["", "s", "ing"])) for _ in range(rng.randint(30, 90))) for _ in range(150)]
    rows = [(i, t, "en", "a") for i, t in enumerate(clean)]
    rows += [(1000 + i, t.replace(" ", "### "), "en", "a") for i, t in enumerate(clean[:5])]
    odd = [None, "", " \n\t ", "x y z  \x1c", "a\n\na\nb\n a\na", "é ü " * 30, "w " * 70000, "\n".join(["one two three"] * 9)]
    rows += [(None if i == 1 else 2000 + i, t, None, None) for i, t in enumerate(odd)] + rows[:1]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, lang string, source string, n_words int, X0 int")
    out = rules.judge(docs).collect()
    assert len(out) == len(rows)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == Counter((d, *brute(t)) for d, t, *_ in rows)
    verdict = {r.doc_id: r.kept for r in out if not r.base_failed}
    assert not any(v for d, v in verdict.items() if d and 1000 <= d < 2000)
    assert all(verdict[d] for d in range(150) if d in verdict)
    assert rules.judge(docs.limit(0)).count() == 0


def test_estimate_withstands_outliers(spark):
    rng = np.random.default_rng(1)
    good = rng.multivariate_normal([1.0, 2.0], [[1.0, 0.6], [0.6, 1.0]], 3000)
    bad = rng.normal([9.0, -7.0], 0.3, (600, 2))
    rows = spark.createDataFrame([("g", *map(float, x)) for x in np.vstack([good, bad])], "group string, x0 double, x1 double")
    est = rules.robust_estimates(rows, 2).first()
    assert np.allclose(est["mean"], [1, 2], atol=0.15)
    cov = np.linalg.inv(np.array(est.inverse).reshape(2, 2)) * est.scale
    # the scale comes from the median of all rows, a sixth of which are outliers, so it is somewhat large
    assert np.allclose(cov, [[1, 0.6], [0.6, 1]], rtol=0.4)
    assert abs(rules.chi_square_quantile(0.95, 6) - 12.592) < 0.05
