"""Scalar functions over the tables, scoring and estimates."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketspark.functions import exprs as e
from docketspark.functions import text as x
from docketspark.operators import scoring
from docketspark.plans.registry import query
from docketspark.schema import POSTING_PARTS, RATES, SECTIONS
from docketspark.sources.binding import AS_OF

c = F.col
_nul = "replace(text, chr(0), '')"
_scrub = f"regexp_replace({_nul}, '\\d{{6}}[-\\s]?[1-4]\\d{{6}}\\b', '[주민번호 제거]', 'g')"
_scrub = f"regexp_replace({_scrub}, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}', '[이메일 제거]', 'g')"
_scrub = f"regexp_replace({_scrub}, '(?:\\+82[-\\s.]?0?|0)\\d{{1,2}}[-\\s.)]?\\d{{3,4}}[-\\s.]?\\d{{4}}\\b', '[전화번호 제거]', 'g')"


@query("scrub_pii", f"SELECT doc_id, {_scrub.replace(_nul, 'text')} AS clean FROM documents")
def scrub_pii(t):
    return t.documents.select("doc_id", e.scrub_pii(c("text")).alias("clean"))


@query("format_money", "SELECT id, CASE WHEN budget_monthly THEN '월 ' ELSE '' END || format('{:,}', floor(budget / 10000.0 + 0.5)::BIGINT) || '만원' AS money FROM projects")
def format_money(t):
    return t.projects.select("id", e.format_money(c("budget"), c("budget_monthly")).alias("money"))


@query("format_kst", "SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y.%m.%d') AS ymd, strftime(ts + INTERVAL 9 HOUR, '%m.%d') AS md, strftime(ts + INTERVAL 9 HOUR, '%m.%d %H:%M') AS mdhm FROM events")
def format_kst(t):
    return t.events.select("event_id", *[e.format_kst(c("ts"), p).alias(n) for n, p in (("ymd", "yyyy.MM.dd"), ("md", "MM.dd"), ("mdhm", "MM.dd HH:mm"))])


_secs = lambda a, b: f"floor((epoch({b}) - epoch({a})) / 86400)::BIGINT"


@query("days_since", f"SELECT id, coalesce(greatest(0, {_secs('completed_at', AS_OF)}), 0) AS days FROM projects")
def days_since(t):
    return t.projects.select("id", e.days_since(c("completed_at"), F.expr(AS_OF)).alias("days"))


@query("days_between", f"SELECT id, CASE WHEN completed_at >= {AS_OF} THEN {_secs(AS_OF, 'completed_at')} END AS days FROM projects")
def days_between(t):
    return t.projects.select("id", e.days_between(F.expr(AS_OF), c("completed_at")).alias("days"))


_dur = lambda a, b, n: f"CASE WHEN {b} >= {a} THEN {_secs(a, b)} END AS {n}"


@query("durations", f"SELECT id, {_dur('submitted_at', 'recruit_started_at', 'inspection')}, {_dur('recruit_started_at', 'progress_started_at', 'recruiting')}, {_dur('progress_started_at', 'completed_at', 'progress')}, {_dur('submitted_at', 'coalesce(completed_at, cancelled_at)', 'total')} FROM projects")
def durations(t):
    pairs = (("submitted_at", c("recruit_started_at"), "inspection"), ("recruit_started_at", c("progress_started_at"), "recruiting"), ("progress_started_at", c("completed_at"), "progress"), ("submitted_at", F.coalesce("completed_at", "cancelled_at"), "total"))
    return t.projects.select("id", *[e.days_between(c(a), b).alias(n) for a, b, n in pairs])


_script = "concat('head [09:99] no: one\n## 전문\n[', turn % 60 + 10, ':05] ', role, ': ', replace(text, ':', ' '), '\nplain line without time\n', turn + 1, ':30 B: bye')"


@query("parse_transcript", rf"""SELECT id, regexp_extract(line, '^\[?(\d{{1,2}}:\d{{2}}(?::\d{{2}})?)\]?\s*([^:]+):\s*(.*)$', 1) AS t, trim(regexp_extract(line, '^\[?(\d{{1,2}}:\d{{2}}(?::\d{{2}})?)\]?\s*([^:]+):\s*(.*)$', 2)) AS who, length(line) AS n
FROM (SELECT conv_id * 1000 + turn AS id, unnest(string_split({_script.replace('head [09:99] no: one' + chr(10) + '## 전문' + chr(10), '')}, chr(10))) AS line FROM conversations) s WHERE regexp_matches(line, '^\[?(\d{{1,2}}:\d{{2}}(?::\d{{2}})?)\]?\s*([^:]+):\s*(.*)$')""")
def parse_transcript(t):
    text = F.concat(F.lit("head [09:99] no: one\n## 전문\n["), (c("turn") % 60 + 10).cast("string"), F.lit(":05] "), "role", F.lit(": "), F.replace("text", F.lit(":"), F.lit(" ")), F.lit("\nplain line without time\n"), (c("turn") + 1).cast("string"), F.lit(":30 B: bye"))
    body = F.substring_index(text, x.TRANSCRIPT_MARK + "\n", -1)
    lines = F.filter(F.split(body, "\n"), lambda s: s.rlike(x.TRANSCRIPT_LINE))
    both = F.arrays_zip(x.transcript_lines(text).alias("l"), lines.alias("raw"))
    rows = t.conversations.select((c("conv_id") * 1000 + c("turn")).alias("id"), F.explode(both).alias("r"))
    return rows.select("id", c("r.l.t").alias("t"), c("r.l.who").alias("who"), F.length("r.raw").alias("n"))


@query("split_lines", "SELECT doc_id, len(list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> ''))::INT AS n, list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')[1] AS first FROM documents")
def split_lines(t):
    lines = x.split_lines(c("text"))
    return t.documents.select("doc_id", F.size(lines).alias("n"), F.try_element_at(lines, F.lit(1)).alias("first"))


@query("content_hash", "SELECT doc_id, sha256(concat(coalesce(text, ''), chr(10), coalesce(lang, ''), chr(10), coalesce(source, ''), chr(10), '')) AS hash FROM documents")
def content_hash(t):
    return t.documents.select("doc_id", e.content_hash(c("text"), c("lang"), c("source"), F.lit(None).cast("string")).alias("hash"))


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k')::INT AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.missing') AS has_missing FROM events")
def json_props(t):
    get = lambda p: F.get_json_object("props", p)
    return t.events.select("event_id", get("$.k").cast("int").alias("k"), get("$.k").isNotNull().alias("has_k"), get("$.missing").isNotNull().alias("has_missing"))


@query("json_unwrap", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE json_extract_string(props, '$.k') END AS k FROM events")
def json_unwrap(t):
    twice = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('\\"')), F.lit('"'))
    i = c("event_id") % 4
    text = F.when(i == 1, twice).when(i == 3, F.lit("not {json")).otherwise(c("props"))
    return t.events.select("event_id", F.get_json_object(e.unwrap_json(text), "$.k").alias("k"))


@query("clean_note", "SELECT doc_id, left(regexp_replace(replace(replace(replace(replace(replace(replace(text, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\n{3,}', chr(10) || chr(10), 'g'), 400) AS note FROM documents")
def clean_note(t):
    return t.documents.select("doc_id", x.clean_note(c("text")).alias("note"))


@query("truncate_text", "SELECT doc_id, left(text, 200) AS title, left(text, 160) AS preview, length(left(text, 7000)) AS n_embed FROM documents")
def truncate_text(t):
    return t.documents.select("doc_id", F.left("text", F.lit(200)).alias("title"), F.left("text", F.lit(160)).alias("preview"), F.length(F.left("text", F.lit(7000))).alias("n_embed"))


_sq = lambda s: f"lower(regexp_replace({s}, '[\\t\\n\\x0B\\f\\r \\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}\\x{{FEFF}}.,!?~\"''`()\\[\\]{{}}·…-]', '', 'g'))"


@query("quote_grounded", f"SELECT a.conv_id, a.turn, length({_sq('left(a.text, 20)')}) >= 6 AND contains({_sq('b.text')}, {_sq('left(a.text, 20)')}) AS grounded FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn - a.turn % 2")
def quote_grounded(t):
    a, b = t.conversations, t.conversations.select("conv_id", c("turn").alias("other"), c("text").alias("source"))
    both = a.withColumn("other", c("turn") - c("turn") % 2).join(b, ["conv_id", "other"])
    return both.select("conv_id", "turn", x.grounded(F.left("text", F.lit(20)), c("source")).alias("grounded"))


@query("grounding_terms", "SELECT doc_id, contains(text, 'the') AND contains(text, 'an') AND NOT contains(lower(text), 'token') AS passes FROM documents")
def grounding_terms(t):
    text = c("text")
    return t.documents.select("doc_id", (F.contains(text, F.lit("the")) & F.contains(text, F.lit("an")) & ~F.contains(F.lower(text), F.lit("token"))).alias("passes"))


@query("drop_echoes", f"SELECT conv_id, turn, (NOT (length({_sq('left(text, 30)')}) >= 8 AND contains({_sq('text')}, {_sq('left(text, 30)')})))::INT + 1 AS n FROM conversations WHERE length({_sq('text')}) > 40")
def drop_echoes(t):
    items = F.array(F.left("text", F.lit(30)), F.lit("short"))
    rows = t.conversations.filter(F.length(e.squash(c("text"))) > 40)
    return rows.select("conv_id", "turn", F.size(x.drop_echoes(items, c("text"))).alias("n"))


@query("tag_whitelist", "SELECT project_id, array_to_string(list_filter(['PROMO', 'STANDARD', 'ECONOMY'], lambda w: list_contains(list_transform(risk_tags, lambda s: string_split(s, ' ')[1]), w)), ',') AS tags FROM insights WHERE risk_tags IS NOT NULL")
def tag_whitelist(t):
    first = F.transform("risk_tags", lambda s: F.split(s, " ")[0])
    allowed = F.array(F.lit("PROMO"), F.lit("STANDARD"), F.lit("ECONOMY"))
    return t.insights.filter("risk_tags is not null").select("project_id", F.array_join(F.array_intersect(allowed, first), ",").alias("tags"))


@query("phone_digits", "SELECT c_custkey, CASE WHEN d LIKE '82%' THEN '0' || substr(d, 3) ELSE d END AS phone FROM (SELECT c_custkey, regexp_replace(CASE WHEN c_custkey % 2 = 0 THEN '+82-10-' ELSE '010 ' END || c_custkey::VARCHAR || '-1234', '[^0-9]', '', 'g') AS d FROM customer) x")
def phone_digits(t):
    raw = F.concat(F.when(c("c_custkey") % 2 == 0, "+82-10-").otherwise("010 "), c("c_custkey").cast("string"), F.lit("-1234"))
    return t.customer.select("c_custkey", e.phone_digits(raw).alias("phone"))


# ---- a posting of a document: a line per four words; some lines are headings or state an absence, by their first letter
_POSTING = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '((?:[^\s]+ ){3}[^\s]+) ', '\1' || chr(10), 'g'),
  '(?m)^([a-c][^\n]*)', '[\1]', 'g'), '(?m)^([d-h])', '1. \1', 'g'), '(?m)^([i-n])', '2-1. \1', 'g'), '(?m)^([o-s][^\n]*)', '- \1 정보 없음.', 'g')"""
_CLEAN_SQL = rf"""
WITH d AS (SELECT doc_id, {_POSTING} AS md FROM documents),
l AS (SELECT doc_id, unnest(string_split(md, chr(10))) AS line, generate_subscripts(string_split(md, chr(10)), 1) AS i FROM d),
k AS (SELECT doc_id, line, i, CASE WHEN regexp_matches(t, '^\[.*\]$') THEN 0 WHEN regexp_matches(t, '^[0-9]+-[0-9]+\.\s') THEN 2 WHEN regexp_matches(t, '^[0-9]+\.\s') THEN 1
    WHEN regexp_matches(t, '{x.ABSENT_END}|{x.ABSENT_LINE}') THEN 5 WHEN t = '' THEN 4 ELSE 3 END AS kind
  FROM (SELECT *, regexp_replace(line, '^\s+|\s+$', '', 'g') AS t FROM l) z),
w AS (SELECT *, min(i) FILTER (WHERE kind = 3) OVER f AS plain, min(i) FILTER (WHERE kind = 0) OVER f AS h0, min(i) FILTER (WHERE kind <= 1) OVER f AS h1, min(i) FILTER (WHERE kind <= 2) OVER f AS h2
  FROM k WINDOW f AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
j AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE kind IN (3, 4) OR kind < 3 AND plain < coalesce(CASE kind WHEN 0 THEN h0 WHEN 1 THEN h1 ELSE h2 END, i + 1000000000)), '') AS md FROM w GROUP BY doc_id)
SELECT d.doc_id, regexp_replace(regexp_replace(j.md, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS clean FROM d LEFT JOIN j USING (doc_id)"""


@query("clean_posting", _CLEAN_SQL)
def clean_posting(t):
    text = F.regexp_replace("text", r"((?:[^\s]+ ){3}[^\s]+) ", "$1\n")
    for pattern, put in ((r"(?m)^([a-c][^\n]*)", "[$1]"), ("(?m)^([d-h])", "1. $1"), ("(?m)^([i-n])", "2-1. $1"), (r"(?m)^([o-s][^\n]*)", "- $1 정보 없음.")):
        text = F.regexp_replace(text, pattern, put)
    return t.documents.select("doc_id", x.clean_posting(text).alias("clean"))


@query("chunk_lines")
def chunk_lines(t):
    return x.chunk_lines(t.documents, "doc_id", "text", 2000)


# ---- scores: section k of a document has confidence (doc_id * (k + 3) + k * 7) % 101, inapplicable when (doc_id + k) % 10 = 0
_values = ", ".join(f"({k}, '{s}', {w}, {str(r).upper()}, {str(na).upper()})" for k, (s, (w, r, na, _)) in enumerate(SECTIONS.items()))
SCORED = f"(SELECT doc_id, section, weight, required, ((doc_id * (k + 3) + k * 7) % 101)::INT AS confidence, NOT (na AND (doc_id + k) % 10 = 0) AS applicable FROM documents, (VALUES {_values}) v(k, section, weight, required, na)) z"


def _scores(t):
    dim = scoring.sections(t.spark)
    rows = t.documents.select("doc_id").crossJoin(F.broadcast(dim))  # twelve rows
    k = c("position")
    return rows.select("doc_id", "section", ((c("doc_id") * (k + 3) + k * 7) % 101).cast("int").alias("confidence"), (~(c("na_allowed") & ((c("doc_id") + k) % 10 == 0))).alias("applicable"))


_TOTAL = "floor(sum(CASE WHEN applicable THEN weight * confidence END)::DOUBLE / sum(CASE WHEN applicable THEN weight END) + 0.5)::BIGINT"


@query("score_total", f"SELECT doc_id, {_TOTAL} AS total FROM {SCORED} GROUP BY doc_id")
def score_total(t):
    return scoring.totals(_scores(t), "doc_id")


@query("score_gate", f"SELECT doc_id, count(*) FILTER (WHERE required AND applicable AND confidence < 60) = 0 AS passes, coalesce(string_agg(section, ',' ORDER BY section) FILTER (WHERE required AND applicable AND confidence < 60), '') AS blocking FROM {SCORED} GROUP BY doc_id")
def score_gate(t):
    return scoring.gate(_scores(t), "doc_id")


@query("score_grade", f"SELECT doc_id, CASE WHEN total < 40 THEN '초기' WHEN total < 70 THEN '진행 중' WHEN total < 85 THEN '등록 가능' ELSE '완성' END AS grade, total >= 70 AND least_core >= 50 AS closable FROM (SELECT doc_id, {_TOTAL} AS total, min(confidence) FILTER (WHERE section IN ('purpose', 'features', 'platform')) AS least_core FROM {SCORED} GROUP BY doc_id) g")
def score_grade(t):
    return scoring.grades(_scores(t), "doc_id")


@query("question_priority", f"SELECT doc_id, section, round(weight * (100 - confidence) / 100.0, 2) AS priority, (row_number() OVER (PARTITION BY doc_id ORDER BY weight * (100 - confidence) DESC, section))::INT AS rank FROM {SCORED} WHERE confidence < 80 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY weight * (100 - confidence) DESC, section) <= 3")
def question_priority(t):
    return scoring.priorities(_scores(t), "doc_id")


_parts = ", ".join(f"('{p}', '{s}', {w})" for p, own in POSTING_PARTS.items() for s, w in own.items())


@query("posting_sections", f"SELECT doc_id, part, round(sum(share * confidence) / sum(share), 2) AS score FROM {SCORED} JOIN (VALUES {_parts}) m(part, s, share) ON m.s = section GROUP BY doc_id, part")
def posting_sections(t):
    return scoring.posting_parts(_scores(t), "doc_id")


_rates = ", ".join(f"('{p}', '{l}', {md}, {price})" for (p, l), (md, price) in RATES.items())
QTY = f"(SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '임베디드 SW' WHEN 1 THEN 'R&D' ELSE '앱' END AS kind, part, level, md, price, (o_orderkey * length(part) + ascii(substr(level, 2, 1))) % 6 - 1 AS qty, (o_orderkey % 4)::DOUBLE AS low, (o_orderkey % 4 + 1)::DOUBLE AS high FROM orders, (VALUES {_rates}) v(part, level, md, price)) q"
_md = "sum(md * greatest(qty, 0) * CASE WHEN part = 'dev' AND kind = '임베디드 SW' THEN 1.3 ELSE 1 END)"
_cost = "sum(md * greatest(qty, 0) * price / 21.0 * CASE WHEN part = 'dev' AND kind = '임베디드 SW' THEN 1.3 ELSE 1 END)"


@query("estimate_cost", f"""SELECT id, round(dev_md::DOUBLE, 4) AS dev_md, round(((cost + qa * 325 + ((md / 21.0 + qa) * 0.15) * 650))::DOUBLE, 3) AS subtotal, round(((cost + qa * 325 + ((md / 21.0 + qa) * 0.15) * 650) * 1.1 + CASE WHEN kind = 'R&D' THEN low * 1000 ELSE 0 END)::DOUBLE, 3) AS total_low,
round(((cost + qa * 325 + ((md / 21.0 + qa) * 0.15) * 650) * 1.1 + CASE WHEN kind = 'R&D' THEN high * 1000 ELSE 0 END)::DOUBLE, 3) AS total_high
FROM (SELECT id, any_value(kind) AS kind, any_value(low) AS low, any_value(high) AS high, {_md}::DOUBLE AS md, {_cost}::DOUBLE AS cost, ({_md} FILTER (WHERE part = 'dev'))::DOUBLE AS dev_md, ({_md} FILTER (WHERE part = 'dev'))::DOUBLE / 21 * 0.15 AS qa FROM {QTY} GROUP BY id) x""")
def estimate_cost(t):
    kind = F.when(c("o_orderkey") % 3 == 0, "임베디드 SW").when(c("o_orderkey") % 3 == 1, "R&D").otherwise("앱")
    rows = t.orders.select(c("o_orderkey").alias("id"), kind.alias("kind"), (c("o_orderkey") % 4).cast("double").alias("rnd_low"), (c("o_orderkey") % 4 + 1).cast("double").alias("rnd_high")).crossJoin(F.broadcast(scoring.rates(t.spark)))  # nine rows
    qty = (c("id") * F.length("part") + F.ascii(F.substring("level", 2, 1))) % 6 - 1
    return scoring.estimate(rows.withColumn("qty", qty)).select("id", F.round("dev_md", 4).alias("dev_md"), *[F.round(n, 3).alias(n) for n in ("subtotal", "total_low", "total_high")])
