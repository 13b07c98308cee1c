"""Packing: exact round trip of the ids, gapless sequences, close to the least number."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docketspark.llm import packing
from docketspark.llm.queries import op4_packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_sequences(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_query_round_trip(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op4_packing(spark, sf_dir).collect()
    tokenizer = Tokenizer.from_file(PATH)
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 0] for d, t in docs.items()}
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
    assert pieces.keys() == docs.keys()
    for d, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) == len(ids[d]) and all(r.length == 2048 for r in own[1:])
    n = check_sequences(rows, 2048)
    assert n <= math.ceil(1.01 * sum(map(len, ids.values())) / 2048) + 1


@pytest.mark.parametrize("histogram", [{1: 5}, {2048: 3}, {1025: 7}, {700: 300, 600: 250, 1400: 90, 31: 800, 2048: 2}, {x: 40 + x % 7 for x in range(100, 2000, 37)}, {x: 1 + x % 60 for x in range(500, 1100, 2)}])
def test_plan_holds_exactly_the_histogram(histogram):
    made, got = packing.plan(histogram), Counter()
    for config, times in made:
        assert times > 0 and sum(x * k for x, k in config.items()) <= 2048
        for x, k in config.items():
            got[x] += k * times
    assert got == Counter(histogram)
    alone = packing.best_fit(histogram, 2048, [])
    assert sum(t for _, t in made) <= 1.005 * sum(t for _, t in alone)


def test_linear_program_beats_best_fit_where_best_fit_wastes():
    """6 + 4 fill a sequence of 10 and so do 5 + 5 and 3 + 3 + 4; the program finds uses near the least number."""
    histogram = {6: 400, 5: 400, 4: 600, 3: 400}
    solution = packing.solve(histogram, 10)
    assert sum(solution.uses.values()) <= 800 and solution.bound <= 800
    assert sum(t for _, t in packing.plan(histogram, 10)) == 800 < sum(t for _, t in packing.best_fit(histogram, 10, []))


def test_sequences_come_from_the_program_within_its_gap(spark):
    """Nearly all sequences are configurations of the program, whose number is near the dual's bound."""
    pieces = packing.pieces_of(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), PATH)
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    demand = {x: n for x, n in histogram.items() if x < 2048}
    solution = packing.solve(demand, 2048)
    assert sum(x * n for x, n in solution.left.items()) <= packing.GAP * solution.bound * 2048
    assert sum(solution.uses.values()) <= 1.002 * solution.bound
    covered = Counter(solution.left)
    for config, times in solution.uses.items():
        assert sum(x * k for x, k in config) <= 2048
        for x, k in config:
            covered[x] += k * times
    assert covered == Counter(demand)
    made = sum(t for _, t in packing.plan(histogram)) - histogram[2048]
    assert made <= 1.001 * solution.bound and made <= sum(t for _, t in packing.best_fit(demand, 2048, [])) + 2


def test_edge_cases(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, None), (4, ""), (5, "word " * 9000), (6, "<|endoftext|> x  y")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, length int, Rank int")
    docs = docs.withColumn("a.b", F.lit(3)).withColumn("__text", F.lit(4))
    out = packing.pack_documents(docs, PATH, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = Counter((d, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids + [0])) for d, t in rows)
    whole = defaultdict(list)
    for r in sorted(out, key=lambda r: r.piece):
        whole[(r.doc_id, r.start if r.doc_id != 5 else 0, r.sequence_id if r.doc_id == 1 else 0, r.offset if r.doc_id == 1 else 0)] += r.ids
    assert Counter((k[0], tuple(v)) for k, v in whole.items()) == want
    check_sequences(out, 2048)
    assert packing.pack_documents(docs.limit(0), PATH).count() == 0
