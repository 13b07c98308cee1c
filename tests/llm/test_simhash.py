"""SimHash groups against a brute-force version, and the edge cases."""

import random

import xxhash

from docketspark.llm import simhash
from docketspark.llm.queries import op9_simhash


def brute(rows):
    """{index: (fingerprint, component id)} by comparing all pairs."""
    prints = []
    for _, text in rows:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [(f"{p:016x}", least.get(find(i))) for i, p in enumerate(prints)]


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = {(doc, *x) for (doc, _), x in zip(rows, brute(rows), strict=True)}
    got = [tuple(r) for r in op9_simhash(spark, sf_dir).collect()]
    assert len(got) == len(rows) and set(got) == want


def test_edge_cases_and_keeping_one(spark):
    words = [f"w{i}" for i in range(300)]
    near = words[:150] + ["other"] + words[151:]
    rows = [(5, " ".join(words)), (3, " ".join(near)), (3, " ".join(near)), (None, " ".join(words)), (7, None), (8, ""), (9, "one two"), (None, "alone in the world here"), (11, "A b C"), (12, "a B c")]
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, fp string, mark int, Same_Id int")
    got = sorted(map(tuple, simhash.near_duplicate_groups(docs).select("doc_id", "fp", "component_id").collect()), key=str)
    want = sorted(((d, int(f, 16) - (1 << 64 if int(f, 16) >> 63 else 0), c) for (d, _), (f, c) in zip(rows, brute(rows), strict=True)), key=str)
    assert got == want
    kept = simhash.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([3, 7, 9, None, 11], key=str)
    none = docs.limit(0)
    assert simhash.near_duplicate_groups(none).count() == 0 and simhash.keep_one_per_group(none).count() == 0


def test_crowded_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    rng = random.Random(5)
    near = {rng.getrandbits(64) for _ in range(40)}
    center = rng.getrandbits(64)
    for _ in range(150):
        x = center
        for bit in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5, 6])):
            x ^= 1 << bit
        near.add(x)
    values = sorted(near)
    signed = lambda v: v - (1 << 64 if v >> 63 else 0)
    fps = spark.createDataFrame([(signed(v), 1 + (v == values[0])) for v in values], "fp long, n long")
    roots = {r.node: r.root for r in simhash.groups_of_links(simhash.close_links(fps)).collect()}
    parent = {v: v for v in values}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= 4:
                parent[find(a)] = find(b)
    groups = lambda label: {frozenset(v for v in values if label(v) == x) for x in {label(v) for v in values}}
    assert groups(find) == groups(lambda v: roots.get(signed(v), signed(v)))


def test_enough_blocks_for_any_count():
    assert [simhash.blocks_for(n) for n in (1, 1 << 13, 1 << 20, 1 << 26)] == [5, 5, 6, 7]
    for blocks in (5, 6, 7):
        assert all(m.bit_count() >= 12 for m in simhash.block_masks(blocks))
