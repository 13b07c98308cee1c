"""Ingestion queries."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from docketspark.functions import exprs as e
from docketspark.operators import ingest as g
from docketspark.plans.registry import query
from docketspark.sources.binding import EVENTS_AS_OF
from docketspark.streaming import windows

c = F.col
_agreed = "coalesce(has_valid_agreement = 1, FALSE)"
_done = "coalesce(agreement_date_completed <> '', FALSE)"
STATE = f"""CASE WHEN coalesce(is_cancelled = 1, FALSE) OR coalesce(is_rejected = 1, FALSE) OR coalesce(date_cancelled <> '', FALSE) OR coalesce(date_rejected <> '', FALSE) THEN '완료(취소)'
  WHEN status = 'completed' OR ({_agreed} AND {_done}) THEN '완료(성공)' WHEN {_agreed} AND coalesce(agreement_date_start_progress <> '', FALSE) THEN '진행'
  WHEN status = 'contracted' OR {_agreed} THEN '계약' WHEN status IN ('recruiting', 'close_recruiting') THEN '모집' WHEN status = 'submitted' THEN '검수' END"""


@query("map_status", f"SELECT id, {STATE} AS state FROM raw_projects")
def map_status(t):
    return t.raw_projects.select("id", g.mapped_status().alias("state"))


_reached = f"CASE WHEN {_agreed} THEN '계약' WHEN coalesce(date_start_recruitment <> '', FALSE) THEN '모집' ELSE '검수' END"


@query("cancel_stage", f"SELECT id, {_reached} AS cancel_stage FROM raw_projects WHERE {STATE} = '완료(취소)'")
def cancel_stage(t):
    return g.mapped(t.raw_projects).filter("cancel_stage is not null").select("id", "cancel_stage")


@query("map_project", f"""SELECT id, state AS status, CASE state WHEN '검수' THEN 1 WHEN '모집' THEN 2 WHEN '계약' THEN 3 WHEN '진행' THEN 4 ELSE 5 END AS stage, CASE WHEN state = '완료(취소)' THEN reached END AS cancel_stage,
  nullif(try_cast(nullif(trim(initial_budget), '') AS DOUBLE), 0)::BIGINT AS initial_budget, try_cast(nullif(trim(term), '') AS DOUBLE)::INT AS term_days, term_type = 'month' AS budget_monthly, is_turnkey = 1 AS is_turnkey
FROM (SELECT *, {STATE} AS state, {_reached} AS reached FROM raw_projects) x WHERE state IS NOT NULL""")
def map_project(t):
    return g.mapped(t.raw_projects)


@query("dedupe_last", "SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def dedupe_last(t):
    return g.last_wins(t.events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id")


@query("latest_per_key", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM (SELECT user_id, event_id, event_type, ts FROM events WHERE event_type = 'click' UNION ALL SELECT user_id, event_id, event_type, ts FROM events WHERE event_type <> 'click' AND value > 10) u) x WHERE n = 1")
def latest_per_key(t):
    from pyspark.sql import Window

    rows = t.events.select("user_id", "event_id", "event_type", "ts", "value")
    both = rows.filter("event_type = 'click'").unionByName(rows.filter("event_type <> 'click' and value > 10"))
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return both.withColumn("n", F.row_number().over(order)).filter("n = 1").select("user_id", "event_id", "event_type")


@query("distinct_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def distinct_union(t):
    return t.customer.select(c("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("fk_split", "SELECT count(*) FILTER (WHERE known) AS insertable, count(*) FILTER (WHERE NOT known) AS skipped FROM (SELECT project_id IN (SELECT id FROM projects WHERE id % 2 = 0) AS known FROM timeline) x")
def fk_split(t):
    yes, no = g.split_known(t.timeline, "project_id", t.projects.filter("id % 2 = 0"), "id")
    return yes.agg(F.count("*").alias("insertable")).crossJoin(no.agg(F.count("*").alias("skipped")))  # one row each


@query("upsert_snapshot", "SELECT id, status, budget FROM previous WHERE id NOT IN (SELECT id FROM projects WHERE id % 5 = 0) UNION ALL SELECT id, status, budget FROM projects WHERE id % 5 = 0")
def upsert_snapshot(t):
    return g.upsert(t.previous.select("id", "status", "budget"), t.projects.filter("id % 5 = 0").select("id", "status", "budget"), ["id"])


@query("insert_ignore", "SELECT owner, project_id FROM favorite UNION SELECT user_id, event_id % 1500 FROM events WHERE event_type = 'view'")
def insert_ignore(t):
    new = t.events.filter("event_type = 'view'").select(c("user_id").alias("owner"), (c("event_id") % 1500).alias("project_id"))
    return g.insert_ignore(t.favorite, new, ["owner", "project_id"])


@query("update_if_changed", "SELECT a.id, a.budget AS before, b.budget AS after FROM previous a JOIN projects b ON a.id = b.id WHERE a.budget IS DISTINCT FROM b.budget")
def update_if_changed(t):
    return g.changed_only(t.previous, t.projects, "id", "budget")


@query("delete_by_key", "SELECT owner, project_id FROM favorite WHERE project_id % 3 <> 0")
def delete_by_key(t):
    return g.delete(t.favorite, t.favorite.filter("project_id % 3 = 0"), ["owner", "project_id"])


@query("upsert_owned", "SELECT id, owner, v FROM (SELECT c_custkey AS id, c_nationkey AS owner, CASE WHEN c_custkey % 50 = 0 THEN 'new' ELSE 'old' END AS v FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY c_custkey), c_nationkey + 100, 'new' FROM customer WHERE c_custkey % 70 = 0) x")
def upsert_owned(t):
    old = t.customer.select(c("c_custkey").alias("id"), c("c_nationkey").alias("owner"), F.lit("old").alias("v"))
    mine = old.filter("id % 50 = 0").withColumn("v", F.lit("new"))
    foreign = old.filter("id % 70 = 0").withColumn("owner", c("owner") + 100).withColumn("v", F.lit("new"))
    return g.upsert_owned(old, mine.unionByName(foreign), "id", "owner")


_FIELDS = (("status", "status"), ("budget", "budget"), ("term_days", "term_days"), ("contract_amount", "contract_amount"), ("inspection_manager", "manager"))
DIFF = " UNION ALL ".join(f"SELECT b.id, '{n}' AS field, a.{f}::VARCHAR AS before, b.{f}::VARCHAR AS after FROM previous a JOIN projects b ON a.id = b.id WHERE a.{f} IS DISTINCT FROM b.{f}" for f, n in _FIELDS)


def _diff(t):
    return g.differences(t.previous, t.projects)


@query("diff_events", f"SELECT id AS project_id, CASE WHEN field = 'status' THEN 'status' ELSE 'change' END AS source, concat(id, ':', field, ':', 'T1') AS source_id, field, before, after FROM ({DIFF}) d")
def diff_events(t):
    return g.change_events(_diff(t), F.lit("T1"))


@query("contract_signed", f"SELECT id, before, after FROM ({DIFF}) d WHERE field = 'status' AND before IN ('검수', '모집') AND after IN ('계약', '진행', '완료(성공)')")
def contract_signed(t):
    return g.contract_signed(_diff(t)).select("id", "before", "after")


_won = lambda v: f"coalesce(format('{{:,}}', floor({v}::BIGINT / 10000.0 + 0.5)::BIGINT) || '만원', '-')"


@query("change_desc", f"SELECT id, field, CASE WHEN field IN ('budget', 'contract_amount') THEN {_won('try_cast(before AS BIGINT)')} || ' → ' || {_won('try_cast(after AS BIGINT)')} WHEN field = 'term_days' THEN coalesce(before || '일', '-') || ' → ' || coalesce(after || '일', '-') ELSE coalesce(before, '-') || ' → ' || coalesce(after, '-') END AS text FROM ({DIFF}) d")
def change_desc(t):
    def show(v):
        money, days = e.format_won(v.try_cast("long")), F.concat(v, F.lit("일"))
        return F.coalesce(F.when(c("field").isin("budget", "contract_amount"), money).when(c("field") == "term_days", days).otherwise(v), F.lit("-"))

    return _diff(t).select("id", "field", F.concat(show(c("before")), F.lit(" → "), show(c("after"))).alias("text"))


@query("embedding_invalidate", "SELECT p.id, a.title IS NOT DISTINCT FROM p.title AND p.id % 9 <> 0 AS kept FROM projects p LEFT JOIN previous a ON a.id = p.id")
def embedding_invalidate(t):
    old = t.previous.select("id", e.content_hash(c("title")).alias("content_hash"), F.lit("vector").alias("embedding"))
    new = t.projects.select("id", e.content_hash(F.when(c("id") % 9 == 0, F.concat("title", F.lit("!"))).otherwise(c("title"))).alias("content_hash"))
    return g.invalidate_embeddings(old, new).select("id", c("embedding").isNotNull().alias("kept"))


@query("calls_admit", "SELECT id, CASE WHEN confidence = 'low' THEN 'rejected' WHEN project_id IN (SELECT id FROM projects WHERE id % 2 = 0) THEN 'ready' ELSE 'waiting' END AS verdict FROM calls")
def calls_admit(t):
    ready, rejected, waiting = g.admitted_calls(t.calls, t.projects.filter("id % 2 = 0"))
    tag = lambda d, v: d.select("id", F.lit(v).alias("verdict"))
    return tag(ready, "ready").unionByName(tag(rejected, "rejected")).unionByName(tag(waiting, "waiting"))


@query("valid_counts", "SELECT event_id, n::BIGINT AS count FROM (SELECT event_id, try_cast(nullif(trim(CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '3' WHEN 2 THEN '-1' WHEN 3 THEN '2.5' WHEN 4 THEN NULL ELSE event_id::VARCHAR END), '') AS DOUBLE) AS n FROM events) x WHERE n >= 0 AND n = floor(n)")
def valid_counts(t):
    k = c("event_id") % 6
    text = F.when(k == 0, "").when(k == 1, "3").when(k == 2, "-1").when(k == 3, "2.5").when(k == 4, F.lit(None)).otherwise(c("event_id").cast("string"))
    return g.valid_counts(t.events.select("event_id", text.alias("raw")), "raw").select("event_id", "count")


@query("keyset_page", "SELECT event_id, event_type FROM events WHERE ts > TIMESTAMP '2024-01-10 00:00:00' OR (ts = TIMESTAMP '2024-01-10 00:00:00' AND event_id > 5) ORDER BY ts, event_id LIMIT 400")
def keyset_page(t):
    return g.keyset_page(t.events, "ts", "event_id", (datetime.datetime(2024, 1, 10), 5), 400).select("event_id", "event_type")


@query("hot_edge", f"SELECT event_id FROM events WHERE ts < {EVENTS_AS_OF} - INTERVAL 15 DAY - INTERVAL 2 MINUTE")
def hot_edge(t):
    return g.settled(t.events, "ts", F.expr(f"{EVENTS_AS_OF} - INTERVAL '15' DAY")).select("event_id")


@query("cursor_max", "SELECT concat(strftime(ts, '%Y-%m-%d %H:%M:%S'), '|', event_id) AS cursor FROM (SELECT date_trunc('second', ts) AS ts, event_id FROM events) x ORDER BY ts DESC, event_id DESC LIMIT 1")
def cursor_max(t):
    return g.greatest_cursor(t.events.select(F.date_trunc("second", "ts").alias("ts"), "event_id"), "ts", "event_id")


@query("cursor_roundtrip", "SELECT event_id, event_type || '|x' AS ts, event_id AS id FROM events")
def cursor_roundtrip(t):
    parts = g.cursor_parts(g.cursor_text(F.concat("event_type", F.lit("|x")), c("event_id")))
    return t.events.select("event_id", parts["ts"].alias("ts"), parts["id"].alias("id"))


@query("cursor_advance", "SELECT policy, waiting, CASE WHEN policy = 'never' OR (policy = 'complete' AND waiting = 1) THEN 'old' WHEN policy = 'given' THEN 'mark' ELSE 'new' END AS cursor FROM (VALUES ('always', 0), ('always', 1), ('complete', 0), ('complete', 1), ('given', 0), ('given', 1), ('never', 0), ('never', 1)) v(policy, waiting)")
def cursor_advance(t):
    rows = [(p, w, g.next_cursor(p, "old", "new", w, "mark")) for p in ("always", "complete", "given", "never") for w in (0, 1)]
    return t.spark.createDataFrame(rows, "policy string, waiting int, cursor string")


# ---- extraction from the source system
_NOTE = "CASE user_id % 4 WHEN 0 THEN 'memo' WHEN 1 THEN 'review_memo' WHEN 2 THEN 'log' ELSE 'memo' END AS note_type, CASE event_id % 3 WHEN 0 THEN 'normal' WHEN 1 THEN 'notice' ELSE 'hidden' END AS flag"
_AUTO = "매니저가 GPT 키워드를 저장했습니다"


@query("note_whitelist", f"SELECT event_id, note_type, flag FROM (SELECT event_id, {_NOTE}, CASE WHEN event_id % 10 = 0 THEN 'x {_AUTO} y' ELSE event_type END AS body FROM events) n WHERE ((note_type = 'memo' AND flag IN ('normal', 'notice')) OR note_type = 'review_memo') AND body NOT LIKE '%{_AUTO}%'")
def note_whitelist(t):
    rows = t.events.selectExpr("event_id", *_NOTE.split(", CASE", 1)[:1], "CASE" + _NOTE.split(", CASE", 1)[1], f"CASE WHEN event_id % 10 = 0 THEN 'x {_AUTO} y' ELSE event_type END AS body")
    typed = ((c("note_type") == "memo") & c("flag").isin("normal", "notice")) | (c("note_type") == "review_memo")
    return rows.filter(typed & ~c("body").contains(_AUTO)).select("event_id", "note_type", "flag")


@query("scalar_subquery_latest", "SELECT c_custkey, (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest FROM customer c")
def scalar_subquery_latest(t):
    latest = t.orders.groupBy(c("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return t.customer.select("c_custkey").join(latest, "c_custkey", "left")


@query("valid_contract_sum", "SELECT o_orderkey, coalesce(sum(floor(l_extendedprice)) FILTER (WHERE l_returnflag <> 'R'), 0)::BIGINT AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def valid_contract_sum(t):
    sums = t.lineitem.filter("l_returnflag <> 'R'").groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.sum(F.floor("l_extendedprice")).alias("total"))
    return t.orders.select("o_orderkey").join(sums, "o_orderkey", "left").withColumn("total", F.coalesce("total", F.lit(0)))


@query("valid_agreement_exists", "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_orderkey = o_orderkey AND l_quantity > 30 AND s_acctbal > 0) AS valid FROM orders")
def valid_agreement_exists(t):
    keys = t.lineitem.filter("l_quantity > 30").join(t.supplier.filter("s_acctbal > 0"), c("s_suppkey") == c("l_suppkey")).select(c("l_orderkey").alias("o_orderkey")).distinct().withColumn("valid", F.lit(True))
    return t.orders.select("o_orderkey").join(keys, "o_orderkey", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


_METHODS = ("위시켓", "외부", "카카오톡", "대면", "화상", "전화")
_method = "CASE l_linenumber % 8 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_METHODS)) + " ELSE '기타' END"
_label = f"concat_ws(' · ', {_method}, CASE WHEN s_name IS NOT NULL THEN concat(s_name, CASE WHEN p_brand IS NOT NULL OR p_size > 10 THEN concat(' (', concat_ws('·', p_brand, CASE WHEN p_size > 10 THEN p_type END), ')') ELSE '' END) END, CASE WHEN l_returnflag = 'R' THEN '계약 성사' END)"
_meet = "{lineitem} l LEFT JOIN (SELECT * FROM {supplier} WHERE s_suppkey % 3 <> 0) s ON s_suppkey = l_suppkey LEFT JOIN (SELECT * FROM {part} WHERE p_partkey % 2 = 0) p ON p_partkey = l_partkey JOIN {orders} o ON o_orderkey = l_orderkey"


@query("meeting_label", f"SELECT l_orderkey, l_linenumber, {_label} AS label FROM {_meet.format(lineitem='lineitem', supplier='supplier', part='part', orders='orders')}")
def meeting_label(t):
    from functools import reduce

    rows = _meetings(t)
    kinds = list(enumerate(_METHODS))
    method = reduce(lambda w, k: w.when(c("l_linenumber") % 8 == k[0], k[1]), kinds[1:], F.when(c("l_linenumber") % 8 == 0, _METHODS[0])).otherwise("기타")
    job = F.when(c("p_size") > 10, c("p_type"))
    brackets = F.when(c("p_brand").isNotNull() | job.isNotNull(), F.concat(F.lit(" ("), F.concat_ws("·", "p_brand", job), F.lit(")"))).otherwise("")
    return rows.select("l_orderkey", "l_linenumber", F.concat_ws(" · ", method, F.concat("s_name", brackets), F.when(c("l_returnflag") == "R", "계약 성사")).alias("label"))


def _meetings(t):
    return t.lineitem.join(t.supplier.filter("s_suppkey % 3 <> 0"), c("s_suppkey") == c("l_suppkey"), "left").join(t.part.filter("p_partkey % 2 = 0"), c("p_partkey") == c("l_partkey"), "left").join(t.orders, c("o_orderkey") == c("l_orderkey"))


@query("meeting_partner_join", f"SELECT o_orderpriority, count(*) AS n, count(s_name) AS partners, count(p_name) AS parts FROM {_meet.format(lineitem='lineitem', supplier='supplier', part='part', orders='orders')} GROUP BY 1")
def meeting_partner_join(t):
    return _meetings(t).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count("s_name").alias("partners"), F.count("p_name").alias("parts"))


@query("group_concat", "SELECT o_custkey, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) AS keys FROM orders GROUP BY 1")
def group_concat(t):
    return t.orders.groupBy("o_custkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",").alias("keys"))


@query("stream_tumbling", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(t):
    return windows.tumbling(t.events).select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("stream_session", "SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS began, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events) a) b GROUP BY user_id, s")
def stream_session(t):
    return windows.sessions(t.events, "6 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("began"), "n")
