"""Queries that select stale derived data."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketspark.operators import derived as d
from docketspark.plans.registry import query
from docketspark.plans.report import DECIDED, LIVE

_live = f"JOIN projects p ON p.id = project_id AND {LIVE}"
_qna = "(SELECT project_id, count(*) AS n FROM timeline WHERE source = 'qna' AND title IS NOT NULL GROUP BY 1)"
_notes = "(SELECT project_id, count(*) AS n FROM timeline WHERE source = 'managenote' AND length(body) > 0 GROUP BY 1)"


@query("qna_threads", "SELECT project_id, count(*) AS n, string_agg(left(title, 5) || '/' || coalesce(left(body, 700), ''), ';' ORDER BY event_at, id) AS threads FROM timeline WHERE source = 'qna' AND title IS NOT NULL GROUP BY 1")
def qna_threads(t):
    one = F.transform("threads", lambda x: F.concat(F.left(x["title"], F.lit(5)), F.lit("/"), F.coalesce(x["body"], F.lit(""))))
    return d.threads(t.timeline).select("project_id", "n", F.array_join(one, ";").alias("threads"))


@query("stale_qna", f"SELECT g.project_id, n FROM {_qna} g JOIN projects p ON p.id = g.project_id AND {LIVE} LEFT JOIN insights ai ON ai.project_id = g.project_id WHERE qna_summary IS NULL OR NOT json_exists(qna_summary, '$.technicalNotes') OR (json_exists(qna_summary, '$.sourceCount') AND n <> json_extract_string(qna_summary, '$.sourceCount')::INT)")
def stale_qna(t):
    return d.stale_questions(t.timeline, t.projects, t.insights).select("project_id", "n")


@query("stale_notes", f"SELECT g.project_id, n FROM {_notes} g JOIN projects p ON p.id = g.project_id AND {LIVE} LEFT JOIN insights ai ON ai.project_id = g.project_id WHERE note_extract IS NULL OR json_extract_string(note_extract, '$.sourceCount')::INT <> n")
def stale_notes(t):
    return d.stale_notes(t.timeline, t.projects, t.insights).select("project_id", "n")


@query("stale_meetings", "SELECT id, source_len FROM calls WHERE length(transcript) >= 100 AND (source_len IS NULL OR source_len <> length(transcript)) ORDER BY created_at DESC, id LIMIT 60")
def stale_meetings(t):
    return d.stale_meetings(t.calls, 100).orderBy(F.desc("created_at"), "id").limit(60).select("id", "source_len")


@query("stale_embeddings", f"SELECT id FROM projects WHERE {LIVE} AND id IN (SELECT project_id FROM postings WHERE length(posting_raw) > 0) AND id NOT IN (SELECT project_id FROM vectors WHERE embedding IS NOT NULL) ORDER BY id LIMIT 60")
def stale_embeddings(t):
    return d.stale_embeddings(t.projects, t.vectors, t.postings).select("id").orderBy("id").limit(d.LIMITS["embed"])


@query("stale_risk", f"SELECT project_id FROM insights ai {_live} WHERE risk_tags IS NULL AND json_array_length(qna_summary, '$.riskSignals') > 0")
def stale_risk(t):
    return d.stale_risk_tags(t.projects, t.insights).select("project_id")


@query("stale_cancel", f"SELECT project_id FROM insights ai {_live} WHERE cancel_tags IS NULL AND json_array_length(note_extract, '$.outcome') > 0 AND status = '완료(취소)'")
def stale_cancel(t):
    return d.stale_cancel_tags(t.projects, t.insights).select("project_id")


@query("stale_supply", f"SELECT id FROM projects p LEFT JOIN insights ai ON ai.project_id = id WHERE supply_tags IS NULL AND {LIVE} AND {DECIDED} ORDER BY recruit_started_at DESC NULLS LAST, id LIMIT 20")
def stale_supply(t):
    return d.stale_supply_tags(t.projects, t.insights).orderBy(F.col("recruit_started_at").desc_nulls_last(), "id").limit(d.LIMITS["supply"]).select("id")
