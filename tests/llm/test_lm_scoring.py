"""Base scores and byte codes against plain versions; the model's probabilities sum to one; edge cases."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from docketspark.llm import lm_scoring as lm
from docketspark.llm.queries import op5_lm_scoring


def tokens(text):
    return (text or "").encode().lower().split() + [b"\n"]


def brute_base(docs):
    train = Counter(w for d, t in docs if zlib.crc32(str(d if d is not None else "").encode()) % 10 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    for d, t in docs:
        own = tokens(t)
        yield d, zlib.crc32(str(d if d is not None else "").encode()) % 10 == 0, len(own), sum(train[w] > 0 for w in own), n, sum(math.log10((train[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)


def plain_ppm(grams, counts, order):
    """A dictionary trie and one loop per gram; grams: (context bytes, byte)."""
    seen = [Counter() for _ in range(order + 1)]
    for (context, byte), n in zip(grams, counts, strict=True):
        for j in range(order + 1):
            if n:
                seen[j][(context[max(0, len(context) - j) :], byte)] += n
    tables = [{} for _ in range(order + 1)]
    for j in range(order + 1):
        for (context, byte), n in seen[j].items():
            tables[j].setdefault(context, {})[byte] = n

    def log_p(context, byte):
        out, excluded = 0.0, set()
        for j in range(order, -1, -1):
            here = {s: n for s, n in tables[j].get(context[max(0, len(context) - j) :], {}).items() if s not in excluded}
            if not here:
                continue
            total = sum(here.values())
            if byte in here:
                return out + math.log10((here[byte] - 0.5) / total)
            out += math.log10(0.5 * len(here) / total)
            excluded |= set(here)
        return out - math.log10(256 - len(excluded))

    return log_p


def plain_repeats(words):
    """Places that the two words before predict, as what followed them last in this text; and how many predictions failed."""
    follow, hits, missed = {}, [], 0
    for i in range(2, len(words)):
        key = (words[i - 2], words[i - 1])
        if key in follow:
            if follow[key] == words[i]:
                hits.append(i)
            else:
                missed += 1
        follow[key] = words[i]
    return hits, missed


def test_byte_codes_equal_a_plain_trie():
    rng = random.Random(4)
    texts = [["".join(rng.choices("abc", k=rng.randint(1, 9))).encode() for _ in range(rng.randint(0, 40))] + [b"\n"] for _ in range(20)]
    texts += [[b"\x00a\x00", "é".encode(), b"\n"], [b"\n"]]
    coded = [bytes(4) + b" " + b" ".join(w) for w in texts]
    plain = [(t[j - 4 : j], t[j]) for t in coded for j in range(5, len(t))]
    gram, owner, word = (np.concatenate(x) for x in zip(*lm.running_grams(texts, 4), strict=True))
    assert [int(g) for g in gram] == [int.from_bytes(c + bytes([s]), "big") for c, s in plain]
    assert owner.tolist() == [i for i, t in enumerate(coded) for _ in range(5, len(t))]
    every = [w for t in texts for w in t]
    assert Counter(word.tolist()) == {i: len(w) + (w != b"\n") for i, w in enumerate(every)}
    counts = np.array([rng.choice([0, 1, 1, 3]) for _ in gram], dtype=float)
    want = plain_ppm(plain, counts.tolist(), 4)
    unique, n = lm._sum_by(gram, counts)
    low = lm.low_levels(*lm._sum_by(lm._suffixes(unique, lm.LOW), n))
    of = dict(zip(gram.tolist(), plain, strict=True))
    suffix = (unique >> 8) & 0xFFFFFF
    for mine in [suffix == x for x in np.unique(suffix)] + [np.isin(suffix, np.unique(suffix)[::2])]:
        for g, x in zip(unique[mine].tolist(), lm.code_lengths(unique[mine], n[mine], low, 4), strict=True):
            assert x == pytest.approx(want(*of[g]), abs=1e-9)
    for context in (b" ", b" a", b"abca", b" zz"):
        assert sum(10 ** want(context, s) for s in range(256)) == pytest.approx(1)


def test_gram_table_finds_what_it_holds():
    rng = np.random.default_rng(3)
    grams = np.unique(np.concatenate([rng.integers(0, 1 << 48, 5000), np.arange(3000)]))
    held, values = grams[::2], rng.random(len(grams[::2]))
    hit, got = lm.GramTable.of(held, values).get(np.concatenate([grams, grams]))
    assert hit.tolist() == np.tile(np.isin(grams, held), 2).tolist() and np.array_equal(got[: len(grams)][::2], values)
    hit, got = lm.GramTable.of(held[:0], values[:0]).get(grams)
    assert not hit.any() and not got.any()


def test_query_equals_brute_force_and_beats_the_base(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: r for r in op5_lm_scoring(spark, sf_dir).collect()}
    assert len(got) == len(docs)
    for d, held, n, known, total, base in brute_base(docs):
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = [r for r in op5_lm_scoring(spark, sf).collect() if r.held_out]
        assert sum(r.score for r in rows) > 0.97 * sum(r.base_score for r in rows)


def test_rare_words_are_joined(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    usual = {r.doc_id: (r.n_known, r.base_score, r.score) for r in lm.score_texts(docs).collect()}
    monkeypatch.setattr(lm, "HOT_WORDS", 10)
    monkeypatch.setattr(lm, "PARTIAL_WORDS", 100)
    for r in lm.score_texts(docs).collect():
        assert (r.n_known, r.base_score, r.score) == (usual[r.doc_id][0], pytest.approx(usual[r.doc_id][1]), pytest.approx(usual[r.doc_id][2]))


def test_repeats_equal_a_plain_version():
    rng = random.Random(5)
    texts = [rng.choices("xyz", k=rng.randint(0, 40)) for _ in range(200)] + [[], list("xyxyxyz")]
    numbers = np.array([ord(w) for t in texts for w in t], dtype=np.int64)
    predicted, held, failed = lm.repeats(numbers, np.array([len(t) for t in texts]))
    want = [plain_repeats(t) for t in texts]
    assert want[-1] == ([4, 5], 1)
    assert held.tolist() == [len(h) for h, _ in want] and failed.tolist() == [m for _, m in want]
    first = np.cumsum([0] + [len(t) for t in texts])
    assert np.flatnonzero(predicted).tolist() == [f + i for f, (h, _) in zip(first, want, strict=False) for i in h]
    assert lm.adaptive_cost(0, 0) == pytest.approx(0) and lm.adaptive_cost(1, 0) == pytest.approx(math.log10(0.5))
    assert lm.adaptive_cost(2, 1) == pytest.approx(math.log10(0.5 * 1.5 / 2 * 0.5 / 3))


def test_edge_cases(spark):
    rows = [(1, "A b A b"), (1, "A b A b"), (None, "q r s"), (10, None), (11, ""), (12, " \x1c  x"), (13, "long " * 50000), (14, "z" * 5000)]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "doc_id long, text string, Score int, word int, `a.b` int, __text int")
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in lm.score_texts(docs).collect()), key=str)
    assert got == sorted(((*x[:5], round(x[5], 6)) for x in brute_base(rows)), key=str)
    assert lm.score_texts(docs.limit(0)).count() == 0
    only_held = docs.filter("crc32(cast(string(doc_id) as binary)) % 10 = 0")
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in lm.score_texts(only_held).collect())


def test_bytes_are_coded_in_running_text(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("ba", "co", "du", "fe") for b in ("l", "mm", "nor", "x", "qu")]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(0, 25)))) for i in range(60)] + [(100, None), (101, "a\x00b a\x00b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    order, grams, counts, asked = lm.ORDER, [], [], {}
    for d, t in rows:
        own = tokens(t)
        text, at, spans = bytes(order) + b" " + b" ".join(own), order + 1, []
        for w in own:
            spans.append((at, min(at + len(w) + 1, len(text))))
            at += len(w) + 1
        skip, _ = plain_repeats(own)
        for i, (a, b) in enumerate(spans):
            for j in range(a, b):
                grams.append((text[j - order : j], text[j]))
                counts.append(int(zlib.crc32(str(d).encode()) % 10 != 0))
                if i not in skip:
                    asked.setdefault(d, []).append(grams[-1])
    code = plain_ppm(grams, counts, order)
    want = {d: lm.adaptive_cost(len(r[0]), r[1]) + sum(code(*g) for g in asked[d]) for d, t in rows for r in [plain_repeats(tokens(t))]}
    for hot, coded in ((lm.HOT_GRAMS, lm.CODED_ROWS), (30, 10), (0, 1)):
        monkeypatch.setattr(lm, "HOT_GRAMS", hot)
        monkeypatch.setattr(lm, "CODED_ROWS", coded)
        assert {r.doc_id: r.score for r in lm.score_texts(docs).collect()} == pytest.approx(want)


def test_the_order_of_known_words_matters(spark):
    rows = [(i, "one small step for some person and a giant leap for others") for i in (1, 2, 3, 4, 5)] + [(6, "giant person leap one a others step and for some small")]
    got = {r.doc_id: r for r in lm.score_texts(spark.createDataFrame([*rows, (7, "one small step for some person and a giant leap others")], "doc_id long, text string")).collect()}
    assert got[6].n_known == got[6].n_tokens and got[6].base_score == pytest.approx(got[7].base_score)
    assert got[7].score > got[6].score + 3
