"""List, search, board and detail queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketspark.functions import exprs as e
from docketspark.operators import listing as m
from docketspark.operators.listing import CaseQuery
from docketspark.plans.registry import query
from docketspark.plans.report import DECIDED, LIVE
from docketspark.schema import MEETING, RECRUIT
from docketspark.sources.binding import AS_OF

CORE = ("id", "title", "status", "budget")
MEETINGS = "(SELECT project_id FROM timeline WHERE source = 'meeting')"


def _list(t, q: CaseQuery):
    return m.filtered(t.projects, t.timeline, t.bodies, q, F.expr(AS_OF))


def core_sql(where: str) -> str:
    return f"SELECT id, title, status, budget FROM projects p WHERE {LIVE} AND {where}"


def listed(name: str, q: CaseQuery, where: str):
    query(name, core_sql(where))(lambda t: _list(t, q).select(*CORE))


listed("list_filtered", CaseQuery(status="진행", manager="Manager 1", recent_days=1500), f"status = '진행' AND inspection_manager = 'manager_1' AND recruit_started_at > {AS_OF} - INTERVAL 1501 DAY")
listed("status_meeting_semi", CaseQuery(status=MEETING), f"status = '모집' AND id IN {MEETINGS}")
listed("status_recruit_anti", CaseQuery(status=RECRUIT), f"status = '모집' AND id NOT IN {MEETINGS}")
listed("filter_manager_in", CaseQuery(manager="Manager 3"), "inspection_manager = 'manager_3'")
listed("filter_manager_other", CaseQuery(manager="other"), "(inspection_manager IS NULL OR inspection_manager NOT IN ('manager_0', 'manager_1', 'manager_2', 'manager_3', 'manager_4'))")
listed("filter_manager_unknown", CaseQuery(manager="Nobody"), "FALSE")
listed("filter_recent_days", CaseQuery(recent_days=180), f"recruit_started_at > {AS_OF} - INTERVAL 181 DAY")
listed("filter_starred", CaseQuery(starred=(1, 2, 3, 5, 8, 13, 21, 34, 97)), "id IN (1, 2, 3, 5, 8, 13, 21, 34, 97)")
listed("filter_starred_none", CaseQuery(starred=()), "FALSE")


def like(field: str, token: str) -> str:
    return f"coalesce({field} ILIKE '%{token}%', FALSE)"


def search_sql(tokens: list[str]) -> tuple[str, str]:
    hit = " AND ".join("(" + " OR ".join(like(f, t) for f in ("id::VARCHAR", "title", "category", "tech", "client_name", "posting_raw")) + ")" for t in tokens)
    fields = (("title", 10), ("category", 5), ("client_name", 3), ("posting_raw", 1))
    either = lambda f, t: f"({like(f, t)} OR {like('tech', t)})" if f == "category" else like(f, t)
    score = " + ".join(f"CASE WHEN {either(f, t)} THEN {w} ELSE 0 END" for t in tokens for f, w in fields)
    return hit, score


_hit, _score = search_sql(["BUILD", "an"])


@query("search_tokens", f"SELECT id, title, status, budget FROM projects p LEFT JOIN postings b ON b.project_id = p.id WHERE {LIVE} AND {_hit}")
def search_tokens(t):
    return _list(t, CaseQuery(text="BUILD  an")).select(*CORE)


@query("search_relevance", f"SELECT id, title, {_score} AS score FROM projects p LEFT JOIN postings b ON b.project_id = p.id WHERE {LIVE} AND {_hit} ORDER BY score DESC, recruit_started_at DESC NULLS LAST, id DESC LIMIT 50")
def search_relevance(t):
    return _list(t, CaseQuery(text="BUILD an")).orderBy(*m.ordering()).limit(50).select("id", "title", "score")


ORDER = "recruit_started_at DESC NULLS LAST, id DESC"


@query("list_page_total", f"SELECT id, title, (SELECT count(*) FROM projects WHERE {LIVE}) AS total FROM projects WHERE {LIVE} ORDER BY {ORDER} LIMIT 25 OFFSET 50")
def list_page_total(t):
    return m.page(_list(t, CaseQuery()), 3).select("id", "title", "total")


@query("low_supply_page", f"""WITH_ROWS SELECT id, title, proposal_count, array_to_string(supply_tags, ',') AS tags, total, 2 AS page FROM (SELECT *, count(*) OVER () AS total FROM projects WHERE {LIVE} AND {DECIDED} AND proposal_count BETWEEN 1 AND 5 ORDER BY {ORDER} LIMIT 25 OFFSET 25) x LEFT JOIN insights ai ON ai.project_id = x.id""".replace("WITH_ROWS ", ""))
def low_supply_page(t):
    return m.low_supply_page(t.projects, t.insights, 2)


@query("list_projection", f"SELECT id, CASE WHEN budget_monthly THEN '월 ' ELSE '' END || format('{{:,}}', floor(budget / 10000.0 + 0.5)::BIGINT) || '만원' AS budget_text, strftime(recruit_started_at + INTERVAL 9 HOUR, '%Y.%m.%d') AS started, coalesce(inspection_manager, '') AS manager, proposal_count FROM projects WHERE {LIVE}")
def list_projection(t):
    return t.projects.filter(e.live()).select("id", e.format_money(F.col("budget"), F.col("budget_monthly")).alias("budget_text"), e.format_kst(F.col("recruit_started_at")).alias("started"), F.coalesce("inspection_manager", F.lit("")).alias("manager"), "proposal_count")


@query("exists_flag", f"SELECT id, status, id IN {MEETINGS} AS meeting_started FROM projects WHERE {LIVE}")
def exists_flag(t):
    flagged = t.projects.filter(e.live()).join(m.meeting_ids(t.timeline), F.col("id") == F.col("meeting_id"), "left")
    return flagged.select("id", "status", F.col("meeting_id").isNotNull().alias("meeting_started"))


BOARD_SQL = f"SELECT *, CASE WHEN status = '모집' AND id IN {MEETINGS} THEN '미팅중' ELSE status END AS board_status FROM projects WHERE {LIVE}"


@query("kanban_topn", f"SELECT id, board_status, (row_number() OVER (PARTITION BY board_status ORDER BY {ORDER}))::INT AS rank FROM ({BOARD_SQL}) b QUALIFY row_number() OVER (PARTITION BY board_status ORDER BY {ORDER}) <= 30")
def kanban_topn(t):
    return m.board(_list(t, CaseQuery()), t.timeline).select("id", "board_status", "rank")


@query("kanban_columns", f"SELECT position::INT AS position, s.board_status, coalesce(n, 0) AS total FROM (VALUES (0, '검수'), (1, '모집'), (2, '미팅중'), (3, '계약'), (4, '진행'), (5, '완료(성공)'), (6, '완료(취소)')) s(position, board_status) LEFT JOIN (SELECT board_status, count(*) AS n FROM ({BOARD_SQL}) b GROUP BY 1) c ON c.board_status = s.board_status")
def kanban_columns(t):
    return m.board_columns(_list(t, CaseQuery()), t.timeline)


@query("detail_by_id", f"SELECT id, title, client_name, category, status, stage, budget, contract_amount FROM projects WHERE {LIVE} AND id = 42")
def detail_by_id(t):
    return m.detail(t.projects, "42").select("id", "title", "client_name", "category", "status", "stage", "budget", "contract_amount")


MILESTONES = " UNION ALL ".join(f"SELECT id, {d} AS happened, '{s}' AS stage, '{x}' AS title FROM projects WHERE {d} IS NOT NULL" for d, s, x in (("recruit_started_at", "모집", "모집 시작"), ("progress_started_at", "진행", "진행 착수"), ("completed_at", "완료", "완료"), ("cancelled_at", "완료(취소)", "취소")))


@query("unpivot_milestones", f"SELECT id, strftime(happened, '%Y-%m-%d') AS day, stage, title FROM ({MILESTONES}) x")
def unpivot_milestones(t):
    return m.milestones(t.projects).select("id", F.date_format("at", "yyyy-MM-dd").alias("day"), "stage", "title")


@query("timeline_merge", f"SELECT id, stage, title, (row_number() OVER (PARTITION BY id ORDER BY happened ASC NULLS LAST, stage, title))::INT AS position FROM ({MILESTONES} UNION ALL SELECT project_id, event_at, source, coalesce(title, '') FROM timeline WHERE source <> 'status') x")
def timeline_merge(t):
    return m.merged_timeline(t.projects, t.timeline).select("id", "stage", "title", "position")


@query("detail_nested", "SELECT project_id, count(*)::INT AS n_events, string_agg(id::VARCHAR || ':' || source, ',' ORDER BY event_at ASC NULLS LAST, id) AS events FROM timeline GROUP BY 1")
def detail_nested(t):
    text = F.array_join(F.transform("events", lambda x: F.concat_ws(":", x["id"].cast("string"), x["source"])), ",")
    return m.nested_events(t.timeline).select("project_id", F.size("events").alias("n_events"), text.alias("events"))


@query("detail_qna", "SELECT project_id, id, title AS question, coalesce(body, '') AS answer, strftime(event_at + INTERVAL 9 HOUR, '%m.%d') AS day FROM timeline WHERE source = 'qna' AND title IS NOT NULL")
def detail_qna(t):
    rows = t.timeline.filter("source = 'qna' and title is not null")
    return rows.select("project_id", "id", F.col("title").alias("question"), F.coalesce("body", F.lit("")).alias("answer"), e.format_kst(F.col("event_at"), "MM.dd").alias("day"))


@query("detail_notes", "SELECT project_id, id, body, (row_number() OVER (PARTITION BY project_id ORDER BY event_at DESC, id DESC))::INT AS position FROM timeline WHERE source = 'managenote' AND length(body) > 0")
def detail_notes(t):
    from pyspark.sql import Window

    order = Window.partitionBy("project_id").orderBy(F.desc("event_at"), F.desc("id"))
    return t.timeline.filter("source = 'managenote' and length(body) > 0").select("project_id", "id", "body", F.row_number().over(order).alias("position"))


@query("call_list", "SELECT id, coalesce(summary, '') AS summary, strftime(created_at, '%Y-%m-%d %H:%M') AS at FROM calls WHERE summary IS NOT NULL OR transcript IS NOT NULL ORDER BY created_at DESC NULLS LAST, id LIMIT 100")
def call_list(t):
    rows = t.calls.filter("summary is not null or transcript is not null").orderBy(F.col("created_at").desc_nulls_last(), "id").limit(100)
    return rows.select("id", F.coalesce("summary", F.lit("")).alias("summary"), F.date_format("created_at", "yyyy-MM-dd HH:mm").alias("at"))


@query("reviews_map", "SELECT project_id, check_quality, check_toxic FROM reviews")
def reviews_map(t):
    return t.reviews


@query("favorites_of_user", "SELECT owner, project_id FROM favorite WHERE owner = (SELECT min(user_id) FROM events)")
def favorites_of_user(t):
    owner = t.events.agg(F.min("user_id").alias("least"))
    return t.favorite.join(F.broadcast(owner), F.col("owner") == F.col("least")).select("owner", "project_id")


@query("last_sync", "SELECT max(happened)::VARCHAR AS latest FROM (SELECT max(event_at) AS happened FROM timeline UNION ALL SELECT max(created_at) FROM calls) x")
def last_sync(t):
    both = t.timeline.select(F.col("event_at").alias("at")).union(t.calls.select("created_at"))
    return both.agg(F.max("at").cast("string").alias("latest"))


@query("notifications", "SELECT id, title FROM projects WHERE FALSE")
def notifications(t):
    """The source has no notifications: always empty."""
    return t.projects.select("id", "title").limit(0)


_TOKENS = ("Tion", "the by", "été", "zzqx", "of")


@query("search_by_index", " UNION ALL ".join(f"SELECT '{w}' AS token, doc_id FROM documents WHERE contains(lower(text), lower('{w}'))" for w in _TOKENS))
def search_by_index(t):
    from docketspark.operators import search_index

    texts = t.documents.select("doc_id", "text")
    index = search_index.build(texts, "doc_id", "text")
    found = [search_index.matches(index, texts, "doc_id", "text", w).select(F.lit(w).alias("token"), "doc_id") for w in _TOKENS]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out
