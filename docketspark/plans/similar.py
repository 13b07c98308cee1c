"""Similarity queries: neighbours of vector 7, whose best similarities are below the default floor, so a lower one is given."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketspark.functions import exprs as e
from docketspark.operators import report
from docketspark.operators import similar as v
from docketspark.plans.registry import query
from docketspark.plans.report import DECIDED, DELTA, LIVE, WON, band_sql
from docketspark.schema import PROPOSAL_BANDS

CASE, FLOOR, SCOPE = 7, 0.2, "1-URGENT"
SIM = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM vectors WHERE project_id = 7)::DOUBLE[])"


def near(limit: int, extra: str = "TRUE", boost: str = "0") -> str:
    return f"(SELECT p.*, {SIM} AS sim FROM projects p JOIN vectors x ON x.project_id = p.id WHERE {LIVE} AND id <> {CASE} AND {extra} ORDER BY 1 - {SIM} - {boost}, id LIMIT {limit})"


POOL = f"(SELECT r.* FROM {near(30)} r, (SELECT coalesce((SELECT sim FROM {near(30)} a ORDER BY sim DESC OFFSET 1 LIMIT 1), (SELECT max(sim) FROM {near(30)} b)) AS anchor) c WHERE sim >= greatest(anchor - 0.06, {FLOOR})) s"


def _q(t):
    return v.query_vector(t.vectors, CASE)


def _pool(t):
    return v.pool(t.projects, t.vectors, _q(t), floor=FLOOR, exclude=CASE)


@query("similar_topk", f"SELECT id, title, round(sim, 6) AS sim FROM {near(8)} s WHERE sim >= {FLOOR}")
def similar_topk(t):
    return v.cards(t.projects, t.vectors, _q(t), 8, FLOOR, exclude=CASE).select("id", "title", F.round("sim", 6).alias("sim"))


_boost = f"CASE WHEN dev_scope = '{SCOPE}' THEN 0.02 ELSE 0 END"


@query("similar_topk_boost", f"SELECT id, title, round(sim, 6) AS sim FROM {near(8, boost=_boost)} s WHERE sim >= {FLOOR}")
def similar_topk_boost(t):
    return v.cards(t.projects, t.vectors, _q(t), 8, FLOOR, exclude=CASE, boost_scope=SCOPE).select("id", "title", F.round("sim", 6).alias("sim"))


_only = f"dev_scope = '{SCOPE}'"


@query("similar_scoped", f"SELECT id, title, round(sim, 6) AS sim FROM {near(8, _only)} s WHERE sim >= {FLOOR}")
def similar_scoped(t):
    return v.cards(t.projects, t.vectors, _q(t), 8, FLOOR, exclude=CASE, scope=SCOPE).select("id", "title", F.round("sim", 6).alias("sim"))


@query("similar_pool_cutoff", f"SELECT id, round(sim, 6) AS sim FROM {POOL}")
def similar_pool_cutoff(t):
    return _pool(t).select("id", F.round("sim", 6).alias("sim"))


DAYS = "extract(DAY FROM progress_started_at - recruit_started_at)"


@query("similar_stats", f"SELECT count(*) AS pool, count(*) FILTER (WHERE {DECIDED}) AS decided, count(*) FILTER (WHERE {WON}) AS won, round(100.0 * (count(*) FILTER (WHERE {WON}))::DOUBLE / nullif(count(*) FILTER (WHERE {DECIDED}), 0)::DOUBLE, 1) AS rate, quantile_cont({DAYS}, 0.5)::DOUBLE AS median_days, count({DAYS}) AS days_sample FROM {POOL}")
def similar_stats(t):
    return v.outcomes(_pool(t))


@query("similar_cancel_stage", f"SELECT label, n, round(100.0 * n::DOUBLE / (sum(n) OVER ())::DOUBLE, 1) AS rate FROM (SELECT cancel_stage AS label, count(*) AS n FROM {near(30)} s WHERE status = '완료(취소)' AND cancel_stage IS NOT NULL GROUP BY 1) g")
def similar_cancel_stage(t):
    return v.cancel_stages(v.ranked(t.projects, t.vectors, _q(t), 30, exclude=CASE))


@query("similar_scope_quartiles", f"SELECT dev_scope AS label, count(*) AS n, quantile_cont(contract_amount, 0.25)::DOUBLE AS q1, quantile_cont(contract_amount, 0.5)::DOUBLE AS q2, quantile_cont(contract_amount, 0.75)::DOUBLE AS q3 FROM {near(30)} s WHERE contract_amount > 0 AND dev_scope IS NOT NULL GROUP BY 1 HAVING count(*) >= 3")
def similar_scope_quartiles(t):
    return v.scope_quartiles(v.ranked(t.projects, t.vectors, _q(t), 30, exclude=CASE))


@query("similar_proposal_buckets", f"SELECT {band_sql('proposal_count', PROPOSAL_BANDS)} AS label, count(*) FILTER (WHERE {DECIDED}) AS decided, round(100.0 * (count(*) FILTER (WHERE {WON}))::DOUBLE / nullif(count(*) FILTER (WHERE {DECIDED}), 0)::DOUBLE, 1) AS rate, min(proposal_count) AS sort_key FROM {near(30)} s WHERE proposal_count IS NOT NULL GROUP BY 1")
def similar_proposal_buckets(t):
    return v.proposal_buckets(v.ranked(t.projects, t.vectors, _q(t), 30, exclude=CASE))


@query("similar_budget_delta", f"SELECT {DELTA} FROM {near(30)} s WHERE contract_amount IS NOT NULL AND budget > 0")
def similar_budget_delta(t):
    return report.budget_delta(v.ranked(t.projects, t.vectors, _q(t), 30, exclude=CASE))


@query("similar_text_pool", f"SELECT s.id, s.title, round(s.sim, 6) AS sim, qna_summary FROM {near(30)} s JOIN insights ai ON ai.project_id = s.id WHERE qna_summary IS NOT NULL")
def similar_text_pool(t):
    rows = v.ranked(t.projects, t.vectors, _q(t), 30, exclude=CASE)
    return v.text_pool(rows, t.insights).withColumn("sim", F.round("sim", 6))


@query("cosine_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_pairs(t):
    a = t.embeddings.select(F.col("vec_id").alias("a"), F.col("embedding").alias("u"), (F.col("vec_id") + 1).alias("b"))
    b = t.embeddings.select(F.col("vec_id").alias("b"), F.col("embedding").alias("w"))
    return a.join(b, "b").select("a", "b", F.round(e.cosine(F.col("u"), F.col("w")), 6).alias("sim"))
