"""Bucketed snapshots: which files a batch writes, what it leaves alone, expiry, other bucket numbers, odd batches."""

import os

import pytest
from pyspark.sql import functions as F

from docketspark.operators import ingest
from docketspark.sources.snapshots import ConcurrentCommit, Merge, SnapshotStore
from docketspark.streaming import ingestion


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def rows(frame):
    return sorted(map(tuple, frame.collect()))


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def test_a_batch_rewrites_its_buckets_only(spark, store):
    whole = spark.range(5000).select("id", (F.col("id") * 2).alias("v"))
    store.merge({"t": Merge(whole, ["id"], buckets=32)})
    assert len(files(store.root)) == 32 and rows(store.read("t")) == rows(whole)
    before, old = files(store.root), store.manifest()["tables"]["t"]["folders"]
    batch = spark.createDataFrame([(3, -1), (4, -2), (6000, -3)], "id long, v long")
    touched = store.touched("t", batch)
    store.merge({"t": Merge(batch, ["id"])}, {"c": "x"})
    new = store.manifest()["tables"]["t"]["folders"]
    assert {int(b) for b in new if new[b] != old[b]} == touched and len(touched) <= 3
    assert len(files(store.root) - before) == len(touched) and before <= files(store.root)
    assert rows(store.read("t")) == rows(ingest.upsert(whole, batch, ["id"])) and store.cursor("c") == "x"
    part = set(rows(store.read("t", touched)))
    assert part < set(rows(store.read("t"))) and {(3, -1), (4, -2), (6000, -3)} <= part


def test_five_hundred_keys_of_many_buckets(spark, store):
    store.merge({"t": Merge(spark.range(20_000).withColumn("v", F.lit(0)), ["id"], buckets=200)})
    before = files(store.root)
    batch = spark.range(500).select((F.col("id") * 7).alias("id"), F.lit(1).alias("v"))
    touched = store.touched("t", batch)
    store.merge({"t": Merge(batch, ["id"])})
    assert len(files(store.root) - before) == len(touched) <= 200
    assert store.read("t").filter("v = 1").count() == 500 and store.read("t").count() == 20_000


def test_kept_rows_repeated_keys_and_empty_batches(spark, store):
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    store.merge({"t": Merge(one, ["k"], buckets=4)})
    store.merge({"t": Merge(spark.createDataFrame([(2, "new"), (3, "c"), (3, "c"), (None, "n")], "k long, v string"), ["k"], replace=False)})
    assert sorted(map(str, rows_of(store))) == sorted(map(str, [(1, "a"), (2, "b"), (3, "c"), (None, "n")]))
    before = files(store.root)
    assert store.merge({"t": Merge(one.limit(0), ["k"])}) == 3 and files(store.root) == before and store.read("t").count() == 4
    assert store.merge({"u": Merge(one.limit(0), ["k"])}) == 4 and store.read("u").columns == ["k", "v"] and store.read("u").count() == 0


def rows_of(store):
    return map(tuple, store.read("t").collect())


def test_expiry_keeps_what_the_last_versions_need(spark, store):
    for v in range(4):
        store.merge({"t": Merge(spark.range(40).withColumn("v", F.lit(v)), ["id"], buckets=2)})
    assert len(files(store.root)) == 8
    held = store.read("t")
    gone = store.expire(keep_versions=1)
    assert len(gone) == 4 and len(files(store.root)) == 4 and rows(held) == rows(store.read("t")) and store.expire(1) == []
    assert {r.v for r in store.read("t").collect()} == {3}


def test_other_bucket_numbers_and_plain_tables(spark, store):
    store.commit({"t": spark.range(100).withColumn("v", F.lit(1))})
    assert store.rebucket("t", ["id"], 8) == 2 and rows(store.read("t")) == [(i, 1) for i in range(100)]
    store.rebucket("t", ["id"], 3)
    assert set(store.manifest()["tables"]["t"]["folders"]) == {"0", "1", "2"} and store.read("t").count() == 100
    store.merge({"t": Merge(spark.createDataFrame([(5, 2)], "id long, v int"), ["id"])})
    assert store.read("t").filter("v = 2").count() == 1 and store.read("t").count() == 100


def test_a_lost_race_and_a_failure_leave_the_old_version(spark, store):
    store.merge({"t": Merge(spark.range(5), ["id"], buckets=2)})
    store._fs.createNewFile(store._path(f"{store.root}/commits/2"))
    with pytest.raises(ConcurrentCommit):
        store.merge({"t": Merge(spark.range(9), ["id"])})
    store.release(2)
    with pytest.raises(Exception):  # noqa: B017 - whatever Spark says
        store.merge({"t": Merge(spark.range(9).select(F.expr("id / 0 + raise_error('no')").alias("id")), ["id"])})
    assert store.read("t").count() == 5 and store.merge({"t": Merge(spark.range(6), ["id"])}) == 2 and store.read("t").count() == 6


def test_cases_and_events_of_a_small_batch(spark, store):
    schema = "id long, status string, budget long, modified string"
    ingestion.commit_cases(store, spark.range(3000).selectExpr("id", "'모집' AS status", "id AS budget", "'t1' AS modified"))
    before = files(store.root)
    ingestion.commit_cases(store, spark.createDataFrame([(7, "계약", 7, "t2"), (9, "모집", 1, "t2"), (9, "모집", 2, "t1")], schema))
    assert len(files(store.root) - before) <= 4 and store.read("cases").count() == 3000
    assert {r.source_id for r in store.read("events").collect()} == {"7:status:t2", "9:budget:t2"}
    ingestion.commit_cases(store, spark.createDataFrame([(7, "계약", 7, "t2")], schema))
    assert store.read("events").count() == 2 and store.cursor("cases") == "t2|7"
