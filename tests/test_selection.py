"""Medians by selection against plain ones."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from docketspark.operators import report
from docketspark.operators.selection import medians


def generated():
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(-50, 50), rng.randrange(10**12)]), rng.randrange(5)) for _ in range(400)]
    return rows + [("crowd", 7, i % 2) for i in range(300)] + [("one", 5, None), ("none", None, None), ("two", -3, 4), ("two", 8, 4)]


@pytest.mark.parametrize("ranges", [2, 5, 1 << 15])
def test_groups(spark, ranges):
    rows = generated()
    df = spark.createDataFrame(rows, "g string, x long, y int")
    got = {r.g: (r.mx, r.my) for r in medians(df, ["g"], {"mx": F.col("x"), "my": F.col("y")}, ranges).collect()}
    middle = lambda g, i: (lambda v: float(statistics.median(v)) if v else None)([r[i] for r in rows if r[0] == g and r[i] is not None])
    want = {g: (middle(g, 1), middle(g, 2)) for g in {r[0] for r in rows}}
    assert got == {g: m for g, m in want.items() if m != (None, None)}


def test_one_row_without_groups(spark):
    df = spark.createDataFrame(generated(), "g string, x long, y int")
    assert medians(df.filter("false"), [], {"m": F.col("x")}).collect()[0].m is None
    assert medians(df.filter("g = 'two'"), [], {"m": F.col("x")}).collect()[0].m == 2.5


def test_reports_hold_no_value_lists(spark, sf_dir):
    from docketspark.sources.binding import Tables

    t = Tables(spark, sf_dir)
    for frame in (report.totals(t.projects), report.stage_days(t.projects), report.managers(t.projects)):
        assert "percentile" not in frame._jdf.queryExecution().optimizedPlan().toString()
