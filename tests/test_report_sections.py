"""The report's parts from one pass: each equals its own query, and the plan reads the cases once."""

import pytest

from docketspark.operators import report
from docketspark.plans import registry
from docketspark.sources.binding import Tables

OWN = {
    "budget": "report_by_budget", "scope": "report_by_scope", "proposals": "report_by_proposals", "low_proposals": "report_low_proposals", "contract": "report_contract_bands", "month": "report_by_month",
    "risk": "report_top_risks", "cancel": "report_cancel_reasons", "supply": "report_supply_traits", "supply_baseline": "report_supply_baseline", "cancel_stage": "insight_top_share",
}


@pytest.fixture(scope="module")
def counted(spark):
    t = Tables(spark, "/root/testdata/sf0.01")
    return report.counted_sections(t.projects, t.insights).cache()


@pytest.mark.parametrize("name", OWN)
def test_part_equals_its_query(spark, counted, name):
    want = registry.queries()[OWN[name]](spark, "/root/testdata/sf0.01").drop("rank")
    got = report.section(counted, name)
    rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want) and got.count() > 0


def test_totals_and_names(spark, counted):
    whole = report.totals(Tables(spark, "/root/testdata/sf0.01").projects).first()
    row = counted.filter("section = 'totals'").first()
    assert (row.n, row.won, row.cancelled, row.pending, row.least, row.most) == (whole.total, whole.won, whole.cancelled, whole.pending, whole.min_amount, whole.max_amount)
    assert round(row.amount / row.paid, 2) == pytest.approx(whole.mean_amount) and {r.section for r in counted.select("section").distinct().collect()} == set(report.SECTIONS)
    with pytest.raises(ValueError):
        report.section(counted, "other")


def test_cases_are_read_once(spark, monkeypatch, tmp_path):
    seen, t = [], Tables(spark, "/root/testdata/sf0.001")
    t.projects.write.parquet(str(tmp_path / "projects"))
    monkeypatch.setattr(report, "keep", lambda df, name: seen.append(df) or df)
    report.counted_sections(spark.read.parquet(str(tmp_path / "projects")), t.insights)
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and "dev_scope" in line for line in plan.split("\n")) == 1 and "term_days" not in plan
