"""The gram index against a scan, for every kind of token."""

import random

import pytest
from pyspark.sql import functions as F

from docketspark.operators import search_index

ODD = [(1, "Case ANALYTICS 관리자 페이지"), (2, None), (3, ""), (4, "ab"), (5, "관리자페이지"), (6, "😀😀x😀"), (None, "case"), (7, "aaaa aaaa"), (7, "aaab"), (8, "CASE%_ 100%")]


def scan(rows, token):
    return sorted(str(k) for k, t in rows if t is not None and k is not None and token.lower() in t.lower())


@pytest.mark.parametrize("parts", [1, 3])
def test_odd_texts(spark, parts):
    df = spark.createDataFrame(ODD, "k long, t string")
    index = search_index.build(df, "k", "t", parts)
    for token in ("case", "관리자", "관리자 페", "aaaa", "aab", "😀x😀", "se%", "%_ 1", "zzz", "analytics 관"):
        assert sorted(str(r.k) for r in search_index.matches(index, df, "k", "t", token).collect()) == [k for k in scan(ODD, token)], token
    assert search_index.matches(index, df, "k", "t", "AB").count() == 2 and search_index.matches(index, df, "k", "t", "").count() == 8
    with pytest.raises(ValueError):
        search_index.candidates(index, "ab")


def test_tokens_of_the_texts(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows, rng = [tuple(r) for r in df.collect()], random.Random(1)
    index = search_index.build(df, "doc_id", "text", 4)
    for _ in range(8):
        text = rng.choice(rows)[1]
        at = rng.randrange(max(1, len(text) - 9))
        token = text[at : at + rng.randrange(3, 9)]
        if len(token) < 3:
            continue
        assert sorted(str(r.doc_id) for r in search_index.matches(index, df, "doc_id", "text", token).collect()) == scan(rows, token)
    rare = max((r[1] for r in rows), key=len)[100:112]
    assert 0 < search_index.candidates(index, rare.lower()).count() < len(rows) / 2
    plan = search_index.candidates(index, "tion")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(gram" in plan
    assert index.filter(F.size("keys") > 0).groupBy("gram").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] == 4


def test_grams_of_many_texts_at_once():
    rng = random.Random(5)
    texts = ["", "ab", "a", *("".join(rng.choice("ab \U0001f600관") for _ in range(rng.randrange(60))) for _ in range(200)), "\U0010ffff\0x"]
    gram, owner = search_index.gram_owners(texts)
    got = list(zip(search_index.gram_strings(gram), owner.tolist(), strict=True))
    assert len(got) == len(set(got)) and set(got) == {(g, i) for i, t in enumerate(texts) for g in search_index.grams_of(t)}
    assert [len(x) for x in search_index.gram_owners([])] == [len(x) for x in search_index.gram_owners(["a", "bc"])] == [0, 0]
