"""Tag bitmaps against list functions and the ranking."""

import pytest
from pyspark.sql import functions as F

from docketspark.functions import rules
from docketspark.operators import report, tag_index
from docketspark.sources.binding import Tables

ROWS = [(1, ["a", "b"]), (2, ["b"]), (32_768, ["a", "b", "b"]), (32_769, ["a"]), (0, ["b", None]), (70_000, ["a", "b", "c"]), (70_000, ["d"]), (5, []), (6, None), (None, ["a"])]


def keys(frame):
    return sorted(r.key for r in frame.collect())


def test_odd_lists(spark):
    index = tag_index.build(spark.createDataFrame(ROWS, "id long, tags array<string>"), "id", "tags")
    assert keys(tag_index.with_all(index, ["a", "b", "a"])) == [1, 32_768, 70_000] and keys(tag_index.with_all(index, ["a", "x"])) == []
    assert keys(tag_index.with_any(index, ["a", "d"])) == [1, 32_768, 32_769, 70_000] and keys(tag_index.with_any(index, [])) == []
    assert {(r.label, r.n) for r in tag_index.counts(index).collect()} == {("a", 4), ("b", 5), ("c", 1), ("d", 1)}
    some = spark.createDataFrame([(1,), (70_000,), (9,), (None,)], "key long")
    assert {(r.label, r.n) for r in tag_index.counts(index, some).collect()} == {("a", 2), ("b", 2), ("c", 1), ("d", 1)}
    with pytest.raises(ValueError):
        tag_index.with_all(index, [])


def test_equals_lists_and_ranking(spark, sf_dir):
    t = Tables(spark, sf_dir)
    index = tag_index.build(t.insights, "project_id", "risk_tags")
    ranked = report.tag_ranking(t.projects, t.insights, "risk_tags").collect()
    live = t.projects.filter("deleted_at is null and not hidden").select(F.col("id").alias("key"))
    assert {(r.label, r.n) for r in tag_index.counts(index, live).collect()} == {(r.label, r.decided) for r in ranked}
    first, second = ranked[0].label, ranked[1].label
    want = lambda c: sorted(r.project_id for r in t.insights.filter(c).collect())
    assert keys(tag_index.with_all(index, [first])) == want(rules.has_tag(F.col("risk_tags"), first))
    assert keys(tag_index.with_any(index, [first, second])) == want(rules.has_any_tag(F.col("risk_tags"), [first, second]))
    assert keys(tag_index.with_all(index, [first, second])) == want(rules.has_tag(F.col("risk_tags"), first) & rules.has_tag(F.col("risk_tags"), second))
