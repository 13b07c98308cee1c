"""Queries of the rules over answers, tags, fields and sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketspark.functions import exprs as e
from docketspark.functions import rules
from docketspark.functions import text as x
from docketspark.operators import derived, ingest, listing, scoring
from docketspark.plans.registry import query
from docketspark.schema import CANCEL_TAGS, CANCELLED, OPTIONS, RISK_TAGS, SECTIONS, SUPPLY_TAGS
from docketspark.sources.binding import EVENTS_AS_OF

c = F.col
#: White space and marks that quotes are compared without, in the oracle's dialect.
_BLANK = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
_sq = lambda s: f"lower(regexp_replace({s}, '[{_BLANK}.,!?~\"''`()\\[\\]{{}}·…-]', '', 'g'))"


@query("squash_text", f"SELECT doc_id, {_sq("concat(text, ' {A}; b: c… ~[d]`e''\"')")} AS squashed FROM documents")
def squash_text(t):
    return t.documents.select("doc_id", e.squash(F.concat("text", F.lit(" {A}; b: c… ~[d]`e'\""))).alias("squashed"))


_subject = "CASE turn % 5 WHEN 0 THEN concat(role, ': ', replace(text, chr(10), ' ')) WHEN 1 THEN concat('고객사 담당：', left(text, 9)) WHEN 2 THEN concat('a much longer head than allowed here: ', turn) WHEN 3 THEN concat('Kim：', conv_id, ' b') ELSE text END"
_pattern = rf"'\A([^:：]{{1,24}})[:：][{_BLANK}]*([^\n\r\x{{2028}}\x{{2029}}]+)\z'"
_role = " OR ".join(f"contains(regexp_extract(s, {_pattern}, 1), '{r}')" for r in ("클라이언트", "파트너", "매니저", "고객사", "개발사"))


@query("subject_anonymised", f"SELECT conv_id, turn, CASE WHEN regexp_matches(s, {_pattern}) AND NOT ({_role}) THEN concat('담당자: ', regexp_extract(s, {_pattern}, 2)) ELSE s END AS subject FROM (SELECT conv_id, turn, {_subject} AS s FROM conversations) z")
def subject_anonymised(t):
    i = c("turn") % 5
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    s = F.when(i == 0, F.concat("role", F.lit(": "), flat)).when(i == 1, F.concat(F.lit("고객사 담당："), F.left("text", F.lit(9)))).when(i == 2, F.concat(F.lit("a much longer head than allowed here: "), c("turn").cast("string"))).when(i == 3, F.concat(F.lit("Kim："), c("conv_id").cast("string"), F.lit(" b"))).otherwise(c("text"))
    return t.conversations.select("conv_id", "turn", x.subject_anonymised(s).alias("subject"))


_sections = ", ".join(f"({k}, '{s}', {na}, {g})" for k, (s, (_, _, na, g)) in enumerate(SECTIONS.items()))
_quote = _sq("evidence")
_useless = " OR ".join(f"contains({_sq('g')}, {_sq(repr(w))}) OR contains({_sq(repr(w))}, {_sq('g')})" for w in ("요구사항 정의 필요", "일정 협의 필요", "품질 관리 필요", "예산 확정 필요"))
_shapes = " OR ".join(f"{_sq('g')} = {_sq(repr(w))}" for w in ("보통 … 하는 경우가 많다", "…가 따라오는 편"))


@query("score_assembled", f"""SELECT doc_id, section, confidence, applicable, CASE WHEN ga AND applicable AND confidence < 60 AND answered THEN array_to_string(list_filter([trim(g) FOR g IN guess], lambda g: g <> '' AND NOT ({_useless} OR {_shapes}))[1:3], '|') ELSE '' END AS guesses
FROM (SELECT doc_id, section, ga, k_ok AS answered, CASE WHEN k_ok THEN greatest(0, least(100, floor(((doc_id * (k + 3) + k * 7) % 131) - 10 + 0.5)))::INT ELSE 0 END AS confidence,
  NOT (k_ok AND na AND (doc_id + k) % 4 = 0 AND length(coalesce({_quote}, '')) >= 6 AND contains({_sq('text')}, coalesce({_quote}, ''))) AS applicable,
  ['  ', '일정 협의 필요', concat(' map ', k, ' '), '…가 따라오는 편', 'b c', 'd', 'e'] AS guess
FROM (SELECT doc_id, coalesce(text, '') AS text, k, section, na, ga, (doc_id + k) % 7 <> 0 AS k_ok, CASE (doc_id + k) % 3 WHEN 0 THEN substring(text, 5, 20) WHEN 1 THEN 'no' END AS evidence FROM documents, (VALUES {_sections}) v(k, section, na, ga)) y) z""")
def score_assembled(t):
    dim = F.broadcast(scoring.sections(t.spark))  # twelve rows
    k, d = c("position"), c("doc_id")
    evidence = F.when((d + k) % 3 == 0, F.substring("text", 5, 20)).when((d + k) % 3 == 1, "no")
    guess = F.array(F.lit("  "), F.lit("일정 협의 필요"), F.concat(F.lit(" map "), k.cast("string"), F.lit(" ")), F.lit("…가 따라오는 편"), F.lit("b c"), F.lit("d"), F.lit("e"))
    answers = t.documents.crossJoin(dim).filter((d + k) % 7 != 0)
    answers = answers.select("doc_id", "section", (((d * (k + 3) + k * 7) % 131) - 10).alias("confidence"), ((d + k) % 4 != 0).alias("applicable"), evidence.alias("evidence"), guess.alias("guess"))
    out = scoring.assembled(answers, t.documents.select("doc_id", F.coalesce("text", F.lit("")).alias("source")), "doc_id")
    return out.select("doc_id", "section", c("confidence").cast("int").alias("confidence"), "applicable", F.array_join("guesses", "|").alias("guesses"))


@query("estimate_quantities", "SELECT o_orderkey, CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE greatest(0, floor((o_orderkey % 11 - 3) / 2.0 + 0.5))::BIGINT END AS qty FROM orders")
def estimate_quantities(t):
    raw = F.when(c("o_orderkey") % 9 != 0, (c("o_orderkey") % 11 - 3) / 2.0)
    return t.orders.select("o_orderkey", rules.quantity(raw).alias("qty"))


_options = ", ".join(f"('{k}', '{n}')" for k, n in OPTIONS)


@query("estimate_options", f"""SELECT o_orderkey, option, name, CASE WHEN option = chr(65 + (o_orderkey % 5)::INT) AND o_orderkey % 3 > 0 THEN concat(o_orderkey % 3, '개월') ELSE '미정' END AS period,
CASE o_orderkey % 4 WHEN 0 THEN '임베디드 SW' WHEN 1 THEN 'R&D' ELSE '일반 SW' END AS kind FROM orders, (VALUES {_options}) v(option, name)""")
def estimate_options(t):
    key = c("o_orderkey")
    kind = F.when(key % 4 == 0, "임베디드 SW").when(key % 4 == 1, "R&D").when(key % 4 == 2, "앱")
    period = F.when(key % 3 > 0, F.concat(F.lit(" "), (key % 3).cast("string"), F.lit("개월 "))).otherwise(" ")
    answers = t.orders.select("o_orderkey", F.chr(65 + key % 5).alias("option"), kind.alias("kind"), period.alias("period"))
    return scoring.options(answers, "o_orderkey")


@query("question_guard", "SELECT conv_id, turn, trim(text) AS text, CASE WHEN turn % 4 = 0 THEN '견적' WHEN turn % 4 = 1 THEN '둘다' ELSE '범위' END AS purpose FROM conversations WHERE trim(text) <> ''")
def question_guard(t):
    purpose = F.when(c("turn") % 4 == 0, "견적").when(c("turn") % 4 == 1, "둘다").when(c("turn") % 4 == 2, "other")
    return t.conversations.filter(rules.filled(c("text")).isNotNull()).select("conv_id", "turn", rules.filled(c("text")).alias("text"), rules.question_purpose(purpose).alias("purpose"))


@query("tip_frequency", "SELECT event_id, CASE WHEN event_id % 6 >= 2 THEN event_id % 6 END AS freq FROM events")
def tip_frequency(t):
    return t.events.select("event_id", rules.shown_frequency(c("event_id") % 6).alias("freq"))


def _vocabulary(tags):
    return "[" + ", ".join(f"'{w}'" for w in tags) + "]"


def _tag_query(name, tags):
    n, sql = len(tags), _vocabulary(tags)

    @query(name, f"SELECT o_orderkey, array_to_string(CASE WHEN i = j THEN [{sql}[i]] ELSE [{sql}[i], {sql}[j]] END, ',') AS tags FROM (SELECT o_orderkey, (o_orderkey % {n} + 1)::INT AS i, (o_orderkey * 7 % {n} + 1)::INT AS j FROM orders) z")
    def whitelisted(t):
        words = F.array(*[F.lit(w) for w in tags])
        i, j = ((k % n + 1).cast("int") for k in (c("o_orderkey"), c("o_orderkey") * 7))
        made = F.array(F.element_at(words, i), F.lit("전체"), F.element_at(words, j), F.element_at(words, i))
        return t.orders.select("o_orderkey", F.array_join(rules.whitelisted(made, tags), ",").alias("tags"))


for _name, _tags in (("risk_taxonomy", RISK_TAGS), ("cancel_taxonomy", CANCEL_TAGS), ("supply_taxonomy", SUPPLY_TAGS)):
    _tag_query(_name, _tags)


@query("tag_filter", "SELECT project_id, coalesce(list_contains(supply_tags, t), FALSE) AS has, coalesce(list_has_any(risk_tags, [t, 'nothing']), FALSE) AS has_any FROM insights, (SELECT min(p_type) AS t FROM part) m")
def tag_filter(t):
    tag = t.part.agg(F.min("p_type")).first()[0]
    return t.insights.select("project_id", rules.has_tag(c("supply_tags"), tag).alias("has"), rules.has_any_tag(c("risk_tags"), (tag, "nothing")).alias("has_any"))


@query("update_counts", "SELECT id, cnt AS proposal_count FROM projects JOIN (SELECT o_orderkey AS k, (o_orderkey % 5)::INT AS cnt FROM orders WHERE o_orderkey % 3 <> 0) v ON k = id WHERE proposal_count IS DISTINCT FROM cnt")
def update_counts(t):
    k = c("o_orderkey")
    pair = F.array_sort(F.collect_list(F.struct(k.alias("k"), (k % 5).cast("int").alias("v"))))  # 50 ids a batch at most
    batches = t.orders.filter(k % 3 != 0).groupBy(F.floor(k / 50).alias("batch")).agg(pair.alias("p")).select(c("p.k").alias("ids"), c("p.v").alias("counts"))
    return ingest.update_counts(t.projects, batches).select("id", "proposal_count")


@query("scope_list", "SELECT o_orderkey, array_to_string(list_filter(string_split(concat(replace(o_orderpriority, '-', ','), ',,x'), ','), lambda s: s <> ''), '/') AS scope FROM orders")
def scope_list(t):
    text = F.concat(F.replace("o_orderpriority", F.lit("-"), F.lit(",")), F.lit(",,x"))
    return t.orders.select("o_orderkey", F.array_join(rules.scope_list(text), "/").alias("scope"))


@query("utc_iso", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM events")
def utc_iso(t):
    return t.events.select("event_id", rules.utc_iso(c("ts")).alias("iso"))


@query("full_name", "SELECT c_custkey, coalesce(nullif(trim(concat(coalesce(CASE WHEN c_custkey % 3 > 0 THEN '김' END, ''), coalesce(CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE c_mktsegment END, ''))), ''), c_name) AS name FROM customer")
def full_name(t):
    last, first = F.when(c("c_custkey") % 3 > 0, "김"), F.when(c("c_custkey") % 2 == 0, " ").otherwise(c("c_mktsegment"))
    return t.customer.select("c_custkey", rules.full_name(last, first, c("c_name")).alias("name"))


@query("case_chips", """SELECT id, array_to_string(list_concat(list_filter(string_split(replace(dev_scope, '-', ','), ','), lambda s: s <> ''), list_filter([CASE WHEN id % 2 = 0 THEN '턴키' END,
CASE id % 5 WHEN 0 THEN '아이디어 단계' WHEN 1 THEN '상세 기획 있음' WHEN 2 THEN '기획서 보유' WHEN 3 THEN 'else' END, CASE WHEN proposal_count IS NOT NULL THEN concat('지원 ', proposal_count, '건') END], lambda s: s IS NOT NULL)), ' ') AS chips FROM projects""")
def case_chips(t):
    i = c("id") % 5
    planning = F.when(i == 0, "idea").when(i == 1, "detail").when(i == 2, "document").when(i == 3, "else")
    return t.projects.select("id", F.array_join(rules.chips(F.replace("dev_scope", F.lit("-"), F.lit(",")), c("id") % 2 == 0, planning, c("proposal_count")), " ").alias("chips"))


_span = lambda a, b: f"CASE WHEN {b} >= {a} THEN floor((epoch({b}) - epoch({a})) / 86400)::BIGINT END"


@query("duration_chips", f"""SELECT id, array_to_string(list_filter([CASE WHEN i > 0 THEN concat('검수 ', i) END, CASE WHEN r > 0 THEN concat('모집·계약 ', r) END, CASE WHEN g > 0 THEN concat('진행 ', g) END, CASE WHEN t > 0 THEN concat(CASE WHEN status = '완료(취소)' THEN '취소까지 ' ELSE '총 기간 ' END, t) END], lambda s: s IS NOT NULL), ',') AS chips
FROM (SELECT id, status, {_span('submitted_at', 'recruit_started_at')} AS i, {_span('recruit_started_at', 'progress_started_at')} AS r, {_span('progress_started_at', 'completed_at')} AS g, {_span('submitted_at', 'coalesce(completed_at, cancelled_at)')} AS t FROM projects) z""")
def duration_chips(t):
    spans = [e.days_between(c(a), b) for a, b in (("submitted_at", c("recruit_started_at")), ("recruit_started_at", c("progress_started_at")), ("progress_started_at", c("completed_at")), ("submitted_at", F.coalesce("completed_at", "cancelled_at")))]
    shown = F.transform(rules.duration_chips(*spans, c("status") == CANCELLED), lambda r: F.concat_ws(" ", r["label"], r["days"].cast("string")))
    return t.projects.select("id", F.array_join(shown, ",").alias("chips"))


@query("session_list", "SELECT id, title, updated_at, created_at, coalesce(len(call_ids), 0)::INT AS call_count, draft IS NOT NULL AS has_draft, left(source_text, 160) AS preview FROM sessions WHERE owner = 'owner_3' ORDER BY updated_at DESC, id DESC LIMIT 100")
def session_list(t):
    return listing.sessions_of(t.sessions, "owner_3")


@query("session_detail", "SELECT id, title, updated_at, source_text, draft FROM sessions WHERE id = 103 AND owner = (SELECT max(owner) FROM sessions WHERE id = 103)")
def session_detail(t):
    owner = t.sessions.filter("id = 103").agg(F.max("owner")).first()[0]
    return listing.session_of(t.sessions, owner, 103)


def _renewal(name, field, tags, run):
    @query(name, f"SELECT project_id, CASE WHEN project_id % 4 = 0 THEN concat('{{\"sourceCount\":', project_id % 6, '}}') ELSE {field} END AS value, {tags} IS NULL OR project_id % 4 = 0 AS due FROM insights")
    def renewed(t):
        answers = t.insights.filter(c("project_id") % 4 == 0).select("project_id", F.concat(F.lit('{"sourceCount":'), (c("project_id") % 6).cast("string"), F.lit("}")).alias(field))
        return run(t.insights, answers).select("project_id", c(field).alias("value"), c(tags).isNull().alias("due"))


_renewal("renew_questions", "qna_summary", "risk_tags", derived.renew_questions)
_renewal("renew_notes", "note_extract", "cancel_tags", derived.renew_notes)


@query("rescan_meetings", f"SELECT id, project_id FROM timeline WHERE source = 'meeting' AND event_at >= {EVENTS_AS_OF} - INTERVAL 60 DAY")
def rescan_meetings(t):
    return ingest.rescan(t.timeline.filter("source = 'meeting'"), "event_at", F.expr(EVENTS_AS_OF)).select("id", "project_id")


_pairs = "[{'term': 'The', 'plain': 'article'}, {'term': concat(' ', substring(text, 9, 12), ' '), 'plain': 'own words'}, {'term': '관리 기능', 'plain': 'x'}, {'term': concat(lang, 'zzq'), 'plain': ' p '}, {'term': ' ', 'plain': 'q'}, {'term': 'of', 'plain': '  '}]"
_hay = _sq("coalesce(text, '')")
_filled = "list_filter([{'term': trim(p.term), 'plain': trim(p.plain)} FOR p IN pairs], lambda p: p.term <> '' AND p.plain <> '')"
_said = f"contains(hay, {_sq('p.term')})"


@query("brief_assembled", f"""SELECT doc_id, array_to_string([p.term || '=' || p.plain FOR p IN list_filter(pairs, lambda p: {_said} AND NOT contains(p.term, '기능'))], '|') AS terms,
  array_to_string([p.term || '=' || p.plain FOR p IN list_filter(pairs, lambda p: NOT {_said})], '|') AS concepts
FROM (SELECT doc_id, hay, {_filled} AS pairs FROM (SELECT doc_id, {_hay} AS hay, {_pairs} AS pairs FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL) x) y""")
def brief_assembled(t):
    one = lambda term, plain: F.struct(term.alias("term"), F.lit(plain).alias("plain"))
    own = F.concat(F.lit(" "), F.substring("text", 9, 12), F.lit(" "))
    pairs = F.array(one(F.lit("The"), "article"), one(own, "own words"), one(F.lit("관리 기능"), "x"), one(F.concat("lang", F.lit("zzq")), " p "), one(F.lit(" "), "q"), one(F.lit("of"), "  "))
    shown = lambda found: F.array_join(F.transform(found, lambda p: F.concat(p["term"], F.lit("="), p["plain"])), "|")
    rows = t.documents.filter("text is not null and lang is not null")
    return rows.select("doc_id", shown(rules.brief_terms(pairs, c("text"))).alias("terms"), shown(rules.brief_concepts(pairs, c("text"))).alias("concepts"))


@query("tips_assembled", """SELECT event_id, array_to_string([x.text || ':' || coalesce(CASE WHEN x.freq >= 2 THEN x.freq END::VARCHAR, '-') FOR x IN list_filter([{'text': trim(t.text), 'freq': t.freq} FOR t IN tips], lambda x: x.text <> '')], '|') AS tips,
  array_to_string([w.term || ':' || coalesce(w.n, 1)::VARCHAR FOR w IN list_filter([{'term': trim(k.term), 'n': k.n} FOR k IN words], lambda w: w.term <> '')], '|') AS keywords
FROM (SELECT event_id, [{'text': concat(' ', event_type, ' '), 'freq': (user_id % 4)::INT}, {'text': CASE WHEN event_id % 3 = 0 THEN '  ' ELSE props END, 'freq': NULL}] AS tips,
  [{'term': CASE WHEN event_id % 2 = 0 THEN ' ' ELSE event_type END, 'n': NULL}, {'term': ' user', 'n': user_id::INT}] AS words FROM events) e""")
def tips_assembled(t):
    tip = lambda text, freq: F.struct(text.alias("text"), freq.cast("int").alias("freq"))
    items = F.array(tip(F.concat(F.lit(" "), "event_type", F.lit(" ")), c("user_id") % 4), tip(F.when(c("event_id") % 3 == 0, "  ").otherwise(c("props")), F.lit(None)))
    word = lambda term, n: F.struct(term.alias("term"), n.cast("int").alias("count"))
    words = F.array(word(F.when(c("event_id") % 2 == 0, " ").otherwise(c("event_type")), F.lit(None)), word(F.lit(" user"), c("user_id")))
    tips = F.transform(rules.tips(items), lambda x: F.concat(x["text"], F.lit(":"), F.coalesce(x["freq"].cast("string"), F.lit("-"))))
    keys = F.transform(rules.keywords(words), lambda w: F.concat(w["term"], F.lit(":"), w["count"].cast("string")))
    return t.events.select("event_id", F.array_join(tips, "|").alias("tips"), F.array_join(keys, "|").alias("keywords"))
