"""Exact similar-case search by cosine, and statistics of the similar cases.

The query vector is one row and is broadcast; the top of the scan is a TakeOrderedAndProject of a bounded number of rows. That pool
(POOL rows at most) is written once, since every later statistic reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.functions import exprs as e
from docketspark.operators import report
from docketspark.schema import MIN_SCOPE, MIN_SIMILARITY, POOL, PROPOSAL_BANDS, REL_MARGIN, SCOPE_BOOST
from docketspark.sources.snapshots import keep


def query_vector(vectors: DataFrame, case_id: int) -> DataFrame:
    """One row with the stored vector of a case; none if it has no vector."""
    return vectors.filter((F.col("project_id") == case_id) & F.col("embedding").isNotNull()).select(F.col("embedding").alias("q")).limit(1)


def ranked(projects: DataFrame, vectors: DataFrame, q: DataFrame, limit: int, exclude: int | None = None, boost_scope: str | None = None, scope: str | None = None) -> DataFrame:
    """The `limit` live cases nearest to q's vector, with sim; boost_scope moves a case of equal scope up a little, scope is a hard filter."""
    rows = projects.filter(e.live())
    if exclude is not None:
        rows = rows.filter(F.col("id") != exclude)
    if scope is not None:
        rows = rows.filter(F.col("dev_scope") == scope)
    rows = rows.join(vectors.filter("embedding is not null"), F.col("id") == F.col("project_id")).crossJoin(F.broadcast(q))  # one query row
    rows = rows.withColumn("sim", e.cosine(F.col("embedding"), F.col("q"))).drop("embedding", "q", "project_id")
    distance: Column = 1 - F.col("sim")
    if boost_scope is not None:
        distance = distance - F.when(F.col("dev_scope") == boost_scope, SCOPE_BOOST).otherwise(0.0)
    return rows.withColumn("distance", distance).orderBy(F.col("distance").asc_nulls_last(), "id").limit(limit)


def cards(projects: DataFrame, vectors: DataFrame, q: DataFrame, limit: int, floor: float = MIN_SIMILARITY, **options) -> DataFrame:
    """The nearest cases first, the floor after: fewer than limit rows may remain."""
    return ranked(projects, vectors, q, limit, **options).filter(F.col("sim") >= floor)


def pool(projects: DataFrame, vectors: DataFrame, q: DataFrame, floor: float = MIN_SIMILARITY, margin: float = REL_MARGIN, size: int = POOL, **options) -> DataFrame:
    """The nearest `size` cases down to the second best similarity less the margin, or to the floor if that is higher."""
    rows = keep(ranked(projects, vectors, q, size, **options), "similar-pool")
    best = F.sort_array(F.collect_list("sim"), asc=False)
    cut = rows.agg(F.coalesce(F.try_element_at(best, F.lit(2)), F.try_element_at(best, F.lit(1))).alias("anchor"))
    return rows.crossJoin(F.broadcast(cut)).filter(F.col("sim") >= F.greatest(F.col("anchor") - margin, F.lit(floor))).drop("anchor")


def outcomes(rows: DataFrame) -> DataFrame:
    days = e.whole_days(F.col("recruit_started_at"), F.col("progress_started_at"))
    return rows.agg(F.count("*").alias("pool"), F.count_if(e.decided()).alias("decided"), F.count_if(e.won()).alias("won"), e.rate().alias("rate"), F.percentile(days, 0.5).alias("median_days"), F.count(days).alias("days_sample"))


def cancel_stages(rows: DataFrame) -> DataFrame:
    return report.composition(rows.filter(e.cancelled() & F.col("cancel_stage").isNotNull()), F.col("cancel_stage"))


def scope_quartiles(rows: DataFrame, least: int = MIN_SCOPE) -> DataFrame:
    paid = rows.filter((F.col("contract_amount") > 0) & F.col("dev_scope").isNotNull())
    out = paid.groupBy(F.col("dev_scope").alias("label")).agg(F.count("*").alias("n"), *[F.percentile("contract_amount", p).alias(k) for k, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))])
    return out.filter(F.col("n") >= least)


def proposal_buckets(rows: DataFrame) -> DataFrame:
    return report.win_rates(rows.filter("proposal_count is not null"), e.band(F.col("proposal_count"), PROPOSAL_BANDS), 0, by=F.col("proposal_count")).orderBy("sort_key")


def text_pool(rows: DataFrame, insights: DataFrame) -> DataFrame:
    """The pool's cases that have a question summary."""
    return rows.join(insights.filter("qna_summary is not null").select("project_id", "qna_summary"), F.col("id") == F.col("project_id")).select("id", "title", "sim", "qna_summary")
