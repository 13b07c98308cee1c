import re

from pyspark.sql import functions as F

import corpus_pipeline
from docketspark.llm.common import materialize


def test_stages_on_their_own_input(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "secret_scans", "mixing", "best_fit_packing"]
    rows, steps = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        rows = materialize(stage(spark, rows, sf_dir), f"test-{name}")
        steps[name] = rows
        if name != names[-1]:
            assert rows.schema.simpleString() == docs.schema.simpleString()
    good = steps["quality_classifier"]
    assert 0 < good.count() <= docs.count()
    # brute force over all pairs: five-word shingles, similarity of 0.8 or more
    rows = good.select("doc_id", "text").collect()
    words = {r.doc_id: (r.text or "").encode().lower().split() for r in rows}
    shingles = {d: {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for d, w in words.items()}
    ids, root = sorted(shingles), {i: i for i in shingles}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            common = len(shingles[i] & shingles[j])
            if 5 * common >= 4 * (len(shingles[i]) + len(shingles[j]) - common):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    kept = {r.doc_id for r in steps["simhash_near_dedup"].select("doc_id").collect()}
    assert kept == {i for i in ids if top(i) == i}
    clean = steps["secret_scans"]
    assert clean.count() == len(kept)
    leaks = clean.filter(F.col("text").rlike('(?i)token = "[0-9a-f]{40}')).count()
    assert leaks == 0
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in clean.collect()}
    mixed = [r.doc_id for r in steps["mixing"].select("doc_id").collect()]
    assert set(mixed) <= kept and max(mixed.count(i) for i in set(mixed)) <= 2
    assert sum(sizes[i] for i in mixed) <= 1.5 * sum(sizes.values())
    packed = steps["best_fit_packing"]
    loads = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert loads.filter("n > 2048 or n <> end").count() == 0
    assert packed.filter("piece = 0").count() == len(mixed)


def test_stages_on_odd_rows(spark, sf_dir):
    """Nulls in any column, empty and long texts, repeated rows, ties, extra columns with clashing names, and no rows at all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (900001, "", "en", "src0", 0), (900001, "", "en", "src0", 0), (900002, "word " * 60_000, None, "src1", 300_000), (900003, 'a token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" b', "en", None, None)], docs.schema)
    rows = docs.limit(40).unionByName(odd).unionByName(docs.limit(3)).withColumn("a.b", F.lit(1)).withColumn("__text", F.lit("x")).withColumn("score", F.lit(2))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, sf_dir)
        assert out.columns == rows.columns, name
        got = out.groupBy("doc_id").count().collect()
        assert {r.doc_id for r in got} <= {r.doc_id for r in rows.select("doc_id").collect()} and got, name
        assert stage(spark, rows.limit(0), sf_dir).count() == 0, name
    packed = corpus_pipeline.STAGES[-1][1](spark, rows, sf_dir)
    assert packed.filter("piece = 0").count() == rows.count()
    assert corpus_pipeline.STAGES[-1][1](spark, rows.limit(0), sf_dir).count() == 0


def test_run_gives_the_last_stage(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).columns[:3] == ["doc_id", "piece", "start"]
