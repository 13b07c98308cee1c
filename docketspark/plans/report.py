"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketspark.functions import exprs as e
from docketspark.operators import report as r
from docketspark.plans.registry import query
from docketspark.schema import BUDGET_BANDS, CONTRACT_BANDS, LOW_SUPPLY_MAX, MIN_SAMPLE, PROPOSAL_BANDS, RISK_TOP_N, SUPPLY_MIN_SAMPLE
from docketspark.sources.binding import AS_OF

LIVE = "deleted_at IS NULL AND NOT hidden"
WON = "(stage >= 3 AND status <> '완료(취소)')"
DECIDED = f"({WON} OR status = '완료(취소)')"
RATE = f"round(100.0 * (count(*) FILTER (WHERE {WON}))::DOUBLE / nullif(count(*) FILTER (WHERE {DECIDED}), 0)::DOUBLE, 1)"
N_DECIDED = f"count(*) FILTER (WHERE {DECIDED})"
TOTALS = f"""count(*) AS total, count(*) FILTER (WHERE {WON}) AS won, count(*) FILTER (WHERE status = '완료(취소)') AS cancelled,
  count(*) FILTER (WHERE stage < 3 AND status <> '완료(취소)') AS pending, quantile_cont(contract_amount, 0.5) FILTER (WHERE contract_amount > 0)::DOUBLE AS median_amount,
  round(avg(contract_amount) FILTER (WHERE contract_amount > 0), 2) AS mean_amount, min(contract_amount) FILTER (WHERE contract_amount > 0) AS min_amount,
  max(contract_amount) FILTER (WHERE contract_amount > 0) AS max_amount"""


def band_sql(column: str, bands: tuple) -> str:
    return "CASE " + " ".join(f"WHEN {column} < {top} THEN '{label}'" for top, label in bands[:-1]) + f" ELSE '{bands[-1][1]}' END"


def rates_sql(label: str, where: str = "TRUE", having: int = MIN_SAMPLE) -> str:
    return f"SELECT {label} AS label, {N_DECIDED} AS decided, {RATE} AS rate FROM projects WHERE {LIVE} AND {where} GROUP BY 1 HAVING {N_DECIDED} >= {having}"


@query("scan_live", f"SELECT id, title, status, stage, budget FROM projects WHERE {LIVE}")
def scan_live(t):
    return t.projects.filter(e.live()).select("id", "title", "status", "stage", "budget")


@query("report_totals", f"SELECT {TOTALS} FROM projects WHERE {LIVE}")
def report_totals(t):
    return r.totals(t.projects)


@query("report_window", f"SELECT {TOTALS} FROM projects WHERE {LIVE} AND recruit_started_at >= {AS_OF} - INTERVAL 365 DAY")
def report_window(t):
    return r.totals(r.window(t.projects, F.expr(AS_OF), 365))


@query("report_contract_bands", f"SELECT label, n, round(100.0 * n::DOUBLE / (sum(n) OVER ())::DOUBLE, 1) AS rate FROM (SELECT {band_sql('contract_amount', CONTRACT_BANDS)} AS label, count(*) AS n FROM projects WHERE {LIVE} AND contract_amount > 0 GROUP BY 1) b")
def report_contract_bands(t):
    amount = F.col("contract_amount")
    return r.composition(t.projects.filter(e.live() & (amount > 0)), e.band(amount, CONTRACT_BANDS))


@query("report_by_budget", rates_sql(band_sql("budget", BUDGET_BANDS), "budget IS NOT NULL AND NOT budget_monthly"))
def report_by_budget(t):
    rows = t.projects.filter(F.col("budget").isNotNull() & ~F.col("budget_monthly"))
    return r.win_rates(rows, e.band(F.col("budget"), BUDGET_BANDS), by=F.col("budget")).orderBy("sort_key").drop("sort_key")


@query("report_by_scope", rates_sql("dev_scope", "dev_scope IS NOT NULL"))
def report_by_scope(t):
    return r.win_rates(t.projects.filter("dev_scope is not null"), F.col("dev_scope")).orderBy(F.col("rate").desc_nulls_first(), "label")


@query("report_by_proposals", rates_sql(band_sql("proposal_count", PROPOSAL_BANDS), "proposal_count IS NOT NULL"))
def report_by_proposals(t):
    rows = t.projects.filter("proposal_count is not null")
    return r.win_rates(rows, e.band(F.col("proposal_count"), PROPOSAL_BANDS), by=F.col("proposal_count")).orderBy("sort_key").drop("sort_key")


@query("report_low_proposals", rates_sql("proposal_count::VARCHAR || '건'", f"proposal_count BETWEEN 1 AND {LOW_SUPPLY_MAX}", 0))
def report_low_proposals(t):
    return r.win_rates(t.projects.filter(e.low_supply()), F.concat(F.col("proposal_count").cast("string"), F.lit("건")), 0)


JOINED = "projects p JOIN insights ai ON ai.project_id = p.id"
LOW_RATE = "round(100.0 * (count(*) FILTER (WHERE proposal_count BETWEEN 1 AND 5))::DOUBLE / nullif(count(*), 0)::DOUBLE, 1)"


@query("report_supply_traits", f"SELECT label, count(*) AS decided, {LOW_RATE} AS rate FROM (SELECT proposal_count, unnest(supply_tags) AS label FROM {JOINED} WHERE {LIVE} AND {DECIDED}) x GROUP BY 1 HAVING count(*) >= {SUPPLY_MIN_SAMPLE}")
def report_supply_traits(t):
    return r.tag_lift(t.projects, t.insights, "supply_tags", SUPPLY_MIN_SAMPLE)


@query("report_supply_baseline", f"SELECT count(*) AS decided, {LOW_RATE} AS rate FROM {JOINED} WHERE {LIVE} AND {DECIDED} AND len(supply_tags) = 0")
def report_supply_baseline(t):
    return r.tag_baseline(t.projects, t.insights, "supply_tags")


def ranking_sql(tags: str, top: int | None = None) -> str:
    return f"""SELECT label, count(*) AS decided, any_value(pool) AS pool, round(100.0 * count(*)::DOUBLE / nullif(any_value(pool), 0)::DOUBLE, 1) AS rate
FROM (SELECT unnest({tags}) AS label, count(*) OVER () AS pool FROM {JOINED} WHERE {LIVE} AND len({tags}) > 0) x GROUP BY 1""" + (f" ORDER BY 2 DESC, 1 LIMIT {top}" if top else "")


@query("report_cancel_reasons", ranking_sql("cancel_tags"))
def report_cancel_reasons(t):
    return r.tag_ranking(t.projects, t.insights, "cancel_tags")


@query("report_top_risks", ranking_sql("risk_tags", RISK_TOP_N))
def report_top_risks(t):
    return r.tag_ranking(t.projects, t.insights, "risk_tags", RISK_TOP_N)


@query("report_by_month", f"SELECT strftime(recruit_started_at + INTERVAL 9 HOUR, '%Y-%m') AS label, {N_DECIDED} AS decided, {RATE} AS rate FROM projects WHERE {LIVE} AND recruit_started_at IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 24")
def report_by_month(t):
    return r.by_month(t.projects)


def median_days(a: str, b: str) -> str:
    return f"quantile_cont(extract(DAY FROM {b} - {a}), 0.5)::DOUBLE"


@query("report_median_days", f"SELECT {median_days('submitted_at', 'recruit_started_at')} AS inspection, {median_days('recruit_started_at', 'progress_started_at')} AS recruiting, {median_days('progress_started_at', 'completed_at')} AS progress, {median_days('recruit_started_at', 'cancelled_at')} AS cancelled FROM projects WHERE {LIVE}")
def report_median_days(t):
    return r.stage_days(t.projects)


DELTA = "count(*) FILTER (WHERE contract_amount > budget AND contract_amount > 0) AS increased, count(*) FILTER (WHERE contract_amount = budget AND contract_amount > 0) AS same, count(*) FILTER (WHERE contract_amount < budget AND contract_amount > 0) AS decreased, count(*) FILTER (WHERE contract_amount = 0) AS zero_excluded"


@query("report_budget_delta", f"SELECT {DELTA} FROM projects WHERE {LIVE} AND contract_amount IS NOT NULL AND budget > 0")
def report_budget_delta(t):
    return r.budget_delta(t.projects.filter(e.live()))


@query("manager_stats", f"""SELECT manager, total, decided, CASE WHEN decided > 0 THEN floor(won::DOUBLE / decided * 1000 + 0.5) / 10 ELSE 0 END AS contract_rate,
  CASE WHEN decided > 0 THEN floor(cancelled::DOUBLE / decided * 1000 + 0.5) / 10 ELSE 0 END AS cancel_rate, contract_median, floor(days + 0.5)::BIGINT AS recruiting_days, pending, decided < {MIN_SAMPLE} AS low_sample
FROM (SELECT CASE WHEN inspection_manager IN ('manager_0', 'manager_1', 'manager_2', 'manager_3', 'manager_4') THEN replace(inspection_manager, 'manager_', 'Manager ') ELSE inspection_manager END AS manager,
  count(*) AS total, {N_DECIDED} AS decided, count(*) FILTER (WHERE {WON}) AS won, count(*) FILTER (WHERE status = '완료(취소)') AS cancelled, count(*) FILTER (WHERE stage < 3 AND status <> '완료(취소)') AS pending,
  quantile_cont(contract_amount, 0.5) FILTER (WHERE contract_amount > 0)::DOUBLE AS contract_median, {median_days('recruit_started_at', 'progress_started_at')} AS days
  FROM projects WHERE {LIVE} AND inspection_manager IS NOT NULL GROUP BY 1) m""")
def manager_stats(t):
    return r.managers(t.projects)


@query("insight_spread", f"SELECT arg_max(label, (rate, label)) AS best, max(rate) AS best_rate, arg_min(label, (rate, label)) AS worst, min(rate) AS worst_rate, round(max(rate) - min(rate), 1) AS spread FROM ({rates_sql('dev_scope', 'dev_scope IS NOT NULL')}) g WHERE decided >= 100 AND rate IS NOT NULL")
def insight_spread(t):
    return r.spread(report_by_scope(t), 100)


@query("insight_top_share", f"SELECT label, n, round(100.0 * n::DOUBLE / (sum(n) OVER ())::DOUBLE, 1) AS rate, (row_number() OVER (ORDER BY n DESC, label))::INT AS rank FROM (SELECT cancel_stage AS label, count(*) AS n FROM projects WHERE {LIVE} AND cancel_stage IS NOT NULL GROUP BY 1) g QUALIFY row_number() OVER (ORDER BY n DESC, label) <= 3")
def insight_top_share(t):
    return r.top_share(r.composition(t.projects.filter(e.live() & F.col("cancel_stage").isNotNull()), F.col("cancel_stage")))


@query("join_left_insights", f"SELECT id, status, len(risk_tags)::INT AS n_risks, ai.project_id IS NOT NULL AS has_insight FROM projects p LEFT JOIN insights ai ON ai.project_id = p.id WHERE {LIVE}")
def join_left_insights(t):
    size = F.when(F.col("risk_tags").isNotNull(), F.size("risk_tags"))
    return t.projects.filter(e.live()).join(t.insights, F.col("id") == F.col("project_id"), "left").select("id", "status", size.alias("n_risks"), F.col("project_id").isNotNull().alias("has_insight"))


@query("explode_tags", "SELECT project_id, unnest(risk_tags) AS tag FROM insights")
def explode_tags(t):
    return t.insights.select("project_id", F.explode("risk_tags").alias("tag"))


def _counts(section: str, label: str, where: str = "TRUE", rows: str = "projects") -> str:
    paid = "FILTER (WHERE contract_amount > 0)"
    return f"""SELECT '{section}' AS section, {label} AS label, count(*) AS n, count(*) FILTER (WHERE {WON}) AS won, {N_DECIDED} AS decided, count(*) FILTER (WHERE status = '완료(취소)') AS cancelled,
  count(*) FILTER (WHERE stage < 3 AND status <> '완료(취소)') AS pending, count(*) FILTER (WHERE {DECIDED} AND proposal_count BETWEEN 1 AND {LOW_SUPPLY_MAX}) AS low, count(*) {paid} AS paid, (sum(contract_amount) {paid})::DOUBLE AS amount
FROM {rows} WHERE {LIVE} AND {where} GROUP BY 2"""


_tagged = "(SELECT p.*, risk_tags, cancel_tags, supply_tags FROM projects p JOIN insights ai ON ai.project_id = p.id) x"
_by_tag = lambda kind: f"(SELECT p.*, unnest({kind}_tags) AS tag FROM projects p JOIN insights ai ON ai.project_id = p.id) x"
_SECTIONS = " UNION ALL ".join([
    _counts("totals", "''"), _counts("budget", band_sql("budget", BUDGET_BANDS), "budget IS NOT NULL AND NOT budget_monthly"), _counts("scope", "dev_scope", "dev_scope IS NOT NULL"),
    _counts("proposals", band_sql("proposal_count", PROPOSAL_BANDS), "proposal_count IS NOT NULL"), _counts("low_proposals", "proposal_count::VARCHAR || '건'", f"proposal_count BETWEEN 1 AND {LOW_SUPPLY_MAX}"),
    _counts("contract", band_sql("contract_amount", CONTRACT_BANDS), "contract_amount > 0"), _counts("month", "strftime(recruit_started_at + INTERVAL 9 HOUR, '%Y-%m')", "recruit_started_at IS NOT NULL"),
    _counts("cancel_stage", "cancel_stage", "cancel_stage IS NOT NULL"), *[_counts(k, "tag", rows=_by_tag(k)) for k in ("risk", "cancel")], _counts("supply", "tag", DECIDED, _by_tag("supply")),
    *[_counts(f"{k}_pool", "''", f"len({k}_tags) > 0", _tagged) for k in ("risk", "cancel")], _counts("supply_baseline", "''", f"len(supply_tags) = 0 AND {DECIDED}", _tagged),
])


@query("report_sections", _SECTIONS)
def report_sections(t):
    return r.counted_sections(t.projects, t.insights).select("section", "label", "n", "won", "decided", "cancelled", "pending", "low", "paid", F.col("amount").cast("double").alias("amount"))


@query("tags_by_bitmap", f"SELECT label, n FROM (SELECT tag AS label, count(DISTINCT id) AS n FROM {_by_tag('risk')} WHERE {LIVE} GROUP BY 1) y")
def tags_by_bitmap(t):
    from docketspark.operators import tag_index

    return tag_index.counts(tag_index.build(t.insights, "project_id", "risk_tags"), t.projects.filter(e.live()).select(F.col("id").alias("key")))
