"""Derived data that is due, kept up to date from change feeds, against a full scan of every version."""

import pytest
from pyspark.sql import functions as F

from docketspark.operators import derived
from docketspark.sources.binding import Tables
from docketspark.sources.snapshots import Merge, SnapshotStore


def pairs(frame):
    return sorted(map(tuple, frame.select("kind", "project_id").collect()))


@pytest.fixture
def store(spark, tmp_path):
    return SnapshotStore(spark, str(tmp_path / "store"))


def test_feed_names_inserts_changes_and_deletes_of_touched_buckets(spark, store):
    store.merge({"t": Merge(spark.range(100).withColumn("v", F.lit(0)), ["id"], buckets=16)})
    store.merge({"t": Merge(spark.createDataFrame([(5, 1), (6, 0), (200, 2)], "id long, v int"), ["id"])})
    store.merge({"t": Merge(spark.createDataFrame([(5, 3)], "id long, v int"), ["id"])})
    got = lambda since: sorted(((r.before and r.before.v, r.after.id, r.after.v) for r in store.feed("t", since).collect()), key=str)
    assert got(1) == [(0, 5, 3), (None, 200, 2)] and got(2) == [(1, 5, 3)] and got(3) == []
    assert store.feed("t", 0).count() == 101
    store.rebucket("t", ["id"], 3)
    assert got(3) == [] and got(2) == [(1, 5, 3)]


def test_due_from_changes_equals_the_full_scan(spark, sf_dir, store):
    t = Tables(spark, sf_dir)
    timeline = t.timeline.select("id", "project_id", "source", "title", "body")
    store.merge({"timeline": Merge(timeline.filter("id % 3 <> 0"), ["id"]), "projects": Merge(t.previous.selectExpr("*", "false AS hidden", "cast(null AS timestamp) AS deleted_at", "cast(null AS timestamp) AS recruit_started_at"), ["id"]), "insights": Merge(t.insights, ["project_id"])})
    columns = store.read("projects").columns
    seen = derived.refresh_due(store, 0)
    at = 1
    moves = [
        {"timeline": Merge(timeline.filter("id % 3 = 0 and id < 200"), ["id"])},  # new events
        {"timeline": Merge(timeline.filter("id between 1 and 40").withColumn("project_id", F.col("project_id") + 1), ["id"])},  # events move to other cases
        {"timeline": Merge(timeline.filter("id between 30 and 60").withColumn("title", F.lit(None).cast("string")).withColumn("body", F.lit("")), ["id"])},  # and cease to count
        {"insights": Merge(t.insights.filter("project_id % 50 = 3").withColumn("qna_summary", F.lit(None).cast("string")).withColumn("risk_tags", F.lit(None).cast("array<string>")), ["project_id"])},
        {"projects": Merge(t.projects.filter("id % 40 = 1").withColumn("hidden", F.lit(True)).select(*columns), ["id"])},
    ]
    for move in moves:
        at = store.merge(move)
        seen = derived.refresh_due(store, at - 1)
        whole = derived.due(derived.counted(store.read("timeline")), store.read("projects"), store.read("insights"))
        assert pairs(store.read("due").filter("is_due")) == pairs(whole)
        assert seen == at + 1
    counts = lambda frame: sorted(map(tuple, frame.select("project_id", "n_qna", "n_notes").collect()))
    assert counts(store.read("case_counts").filter("n_qna + n_notes > 0")) == counts(derived.counted(store.read("timeline")))
    assert pairs(whole) and {k for k, _ in pairs(whole)} >= {"qna", "note", "risk", "supply"}
