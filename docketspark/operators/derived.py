"""Which cases' derived data is stale, and the workers that refresh it."""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketspark.functions import exprs as e
from docketspark.schema import CANCELLED
from docketspark.sources.snapshots import Merge, SnapshotStore, keep

DUE = ("qna", "note", "risk", "cancel", "supply")
LIMITS = {"qna": 40, "embed": 60, "meeting": 6, "note": 30, "risk": 40, "cancel": 30, "supply": 20}


def _live(rows: DataFrame, projects: DataFrame) -> DataFrame:
    return rows.join(projects.filter(e.live()).select(F.col("id").alias("project_id"), "status", "stage", "recruit_started_at"), "project_id")


def _json(column: str, path: str):
    return F.get_json_object(column, path)


def threads(timeline: DataFrame, size: int = 700) -> DataFrame:
    """Per case its titled questions, cut to size, with their number."""
    rows = timeline.filter("source = 'qna' and title is not null")
    one = F.struct("event_at", "id", F.left("title", F.lit(size)).alias("title"), F.left("body", F.lit(size)).alias("body"))
    return rows.groupBy("project_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(one)).alias("threads"))


def counted(timeline: DataFrame) -> DataFrame:
    """project_id, n_qna, n_notes: how many titled questions and filled notes a case has; cases without either are absent."""
    return timeline.groupBy("project_id").agg(F.count_if(_question()).alias("n_qna"), F.count_if(_note()).alias("n_notes")).filter("n_qna + n_notes > 0")


def _question(of: str = "") -> Column:
    return (F.col(f"{of}source") == "qna") & F.col(f"{of}title").isNotNull()


def _note(of: str = "") -> Column:
    return (F.col(f"{of}source") == "managenote") & (F.length(f"{of}body") > 0)


def count_deltas(feed: DataFrame) -> DataFrame:
    """project_id, d_qna, d_notes: what changes (before, after) of events add to or take from a case's counts; an event that moves counts for both cases."""
    signed = F.array(F.struct(F.col("before").alias("e"), F.lit(-1).alias("sign")), F.struct(F.col("after").alias("e"), F.lit(1).alias("sign")))
    rows = feed.select(F.inline(signed)).filter("e is not null")
    sums = [F.sum(F.when(kind("e."), F.col("sign")).otherwise(0)).alias(n) for n, kind in (("d_qna", _question), ("d_notes", _note))]
    return rows.groupBy(F.col("e.project_id").alias("project_id")).agg(*sums)


def next_counts(counts: DataFrame, deltas: DataFrame) -> DataFrame:
    """The new counts of the cases that deltas name; zeros stay, so that they replace what was there."""
    add = lambda n, d: (F.coalesce(n, F.lit(0)) + F.col(d)).cast("long").alias(n)
    return deltas.join(counts, "project_id", "left").select("project_id", add("n_qna", "d_qna"), add("n_notes", "d_notes"))


def due(counts: DataFrame, projects: DataFrame, insights: DataFrame) -> DataFrame:
    """kind, project_id of the derived data that is due: qna, note, risk, cancel, supply; by counts instead of the events themselves."""
    qna = _questions_due(_live(counts.filter("n_qna > 0").select("project_id", F.col("n_qna").alias("n")), projects), insights)
    note = _notes_due(_live(counts.filter("n_notes > 0").select("project_id", F.col("n_notes").alias("n")), projects), insights)
    found = {"qna": qna, "note": note, "risk": stale_risk_tags(projects, insights), "cancel": stale_cancel_tags(projects, insights), "supply": stale_supply_tags(projects, insights).withColumn("project_id", F.col("id"))}
    return reduce(DataFrame.unionByName, [rows.select(F.lit(kind).alias("kind"), "project_id") for kind, rows in found.items()])


def refresh_due(store: SnapshotStore, since: int, tables: tuple[str, str, str] = ("timeline", "projects", "insights")) -> int:
    """Bring the store's tables case_counts and due (kind, project_id, is_due) up to date from what has changed after version `since`; gives the new version.

    Counts move by deltas of the events' change feed; only cases that a feed names are judged, and of all tables only their buckets are read. All three
    tables are bucketed: events by id, cases by id, insights by project_id.
    """
    timeline, projects, insights = tables
    moved = keep(store.feed(timeline, since), "feed-events")
    deltas = keep(count_deltas(moved), "feed-deltas")
    either = lambda feed, key: feed.select(F.coalesce(f"after.{key}", f"before.{key}").alias("project_id"))
    cases = deltas.select("project_id").union(either(store.feed(projects, since), "id")).union(either(store.feed(insights, since), "project_id"))
    cases = keep(cases.filter("project_id is not null").distinct(), "feed-cases")
    known = store.read("case_counts", store.touched("case_counts", cases)) if "case_counts" in store.manifest()["tables"] else deltas.limit(0).selectExpr("project_id", "0L AS n_qna", "0L AS n_notes")
    renewed = keep(next_counts(known, deltas), "feed-counts")
    counts = known.join(renewed, "project_id", "left_anti").unionByName(renewed).join(cases, "project_id", "left_semi")
    part = lambda name, key: store.read(name, store.touched(name, cases.withColumnRenamed("project_id", key))).join(cases.withColumnRenamed("project_id", key), key, "left_semi")
    fresh = due(counts, part(projects, "id"), part(insights, "project_id")).withColumn("is_due", F.lit(True))
    kinds = cases.withColumn("kind", F.explode(F.array(*[F.lit(k) for k in DUE])))
    judged = kinds.join(fresh, ["kind", "project_id"], "left").select("kind", "project_id", F.coalesce("is_due", F.lit(False)).alias("is_due"))
    return store.merge({"case_counts": Merge(renewed, ["project_id"]), "due": Merge(judged, ["project_id", "kind"])})


def _questions_due(rows: DataFrame, insights: DataFrame) -> DataFrame:
    rows = rows.join(insights.select("project_id", "qna_summary"), "project_id", "left")
    said = _json("qna_summary", "$.sourceCount").cast("long")
    return rows.filter(F.col("qna_summary").isNull() | _json("qna_summary", "$.technicalNotes").isNull() | F.coalesce(said != F.col("n"), F.lit(False)))


def _notes_due(rows: DataFrame, insights: DataFrame) -> DataFrame:
    rows = rows.join(insights.select("project_id", "note_extract"), "project_id", "left")
    return rows.filter(F.col("note_extract").isNull() | F.coalesce(_json("note_extract", "$.sourceCount").cast("long") != F.col("n"), F.lit(False)))


def stale_questions(timeline: DataFrame, projects: DataFrame, insights: DataFrame) -> DataFrame:
    """Cases with questions whose summary is missing, of an old version, or counts other questions."""
    return _questions_due(_live(threads(timeline), projects), insights)


def stale_notes(timeline: DataFrame, projects: DataFrame, insights: DataFrame) -> DataFrame:
    notes = timeline.filter(_note()).groupBy("project_id").agg(F.count("*").alias("n"))
    return _notes_due(_live(notes, projects), insights)


def stale_meetings(calls: DataFrame, least: int = 500) -> DataFrame:
    """Transcripts of enough characters without an extract or whose length differs from the extract's."""
    n = F.char_length("transcript")
    return calls.filter((n >= least) & (F.col("source_len").isNull() | (F.col("source_len") != n)))


def stale_embeddings(projects: DataFrame, vectors: DataFrame, postings: DataFrame) -> DataFrame:
    """Live cases with a text and no vector."""
    texts = postings.filter("length(posting_raw) > 0").select(F.col("project_id").alias("id"))
    return projects.filter(e.live()).join(texts, "id", "left_semi").join(vectors.filter("embedding is not null").select(F.col("project_id").alias("id")), "id", "left_anti")


def stale_risk_tags(projects: DataFrame, insights: DataFrame) -> DataFrame:
    return _live(insights.filter(F.col("risk_tags").isNull() & (F.json_array_length(_json("qna_summary", "$.riskSignals")) > 0)), projects)


def stale_cancel_tags(projects: DataFrame, insights: DataFrame) -> DataFrame:
    rows = insights.filter(F.col("cancel_tags").isNull() & (F.json_array_length(_json("note_extract", "$.outcome")) > 0))
    return _live(rows, projects).filter(F.col("status") == CANCELLED)


def stale_supply_tags(projects: DataFrame, insights: DataFrame) -> DataFrame:
    tagged = insights.filter("supply_tags is not null").select(F.col("project_id").alias("id"))
    return projects.filter(e.live() & e.decided()).join(tagged, "id", "left_anti")


def _renewed(insights: DataFrame, answers: DataFrame, field: str, tags: str) -> DataFrame:
    """insights with new values of a field (answers: project_id and the field); the tags that rest on it are emptied, so that they are due again."""
    new = answers.select("project_id", F.col(field).alias("new"), F.lit(True).alias("renewed"))
    rows = insights.join(new, "project_id", "full")
    pick = {field: F.when(F.col("renewed"), F.col("new")).otherwise(F.col(field)), tags: F.when(F.col("renewed").isNull(), F.col(tags))}
    return rows.select(*[pick[c].alias(c) if c in pick else F.col(c) for c in insights.columns])


def renew_questions(insights: DataFrame, answers: DataFrame) -> DataFrame:
    """Question summaries renewed; the risk tags of those cases are due again."""
    return _renewed(insights, answers, "qna_summary", "risk_tags")


def renew_notes(insights: DataFrame, answers: DataFrame) -> DataFrame:
    """Note extracts renewed; the cancellation tags of those cases are due again."""
    return _renewed(insights, answers, "note_extract", "cancel_tags")


class ModelClient(Protocol):
    """Turns a prompt's text into an answer; must be picklable."""

    def __call__(self, text: str) -> str: ...


def offline_model(text: str) -> str:
    """A deterministic stand-in: the first line's first 80 characters."""
    return (text or "").split("\n", 1)[0][:80]


def refresh(targets: DataFrame, key: str, text: str, client: Callable[[str], str] = offline_model, concurrency: int = 4, seconds: float | None = None) -> DataFrame:
    """key, answer, error and state of each target: done, failed (a row with its error, told from an empty answer) or not started.

    A task has at most `concurrency` calls under way; calls of a slow service overlap, and rows come out as they are answered. `seconds` from
    now no further call begins: calls under way are waited for, the rest comes back as not started, to be a target again.
    """
    deadline = time.time() + seconds if seconds is not None else float("inf")

    def called(value: str) -> tuple[str | None, str | None, str]:
        if time.time() >= deadline:
            return None, None, "not started"
        try:
            return client(value), None, "done"
        except Exception as ex:  # noqa: BLE001 - reported as data
            return None, str(ex)[:200], "failed"

    def run(batches):
        with ThreadPoolExecutor(concurrency) as pool:
            for pdf in batches:
                waiting, rows = {}, zip(pdf[key], pdf[text], strict=True)
                more = True
                while more or waiting:
                    while len(waiting) < concurrency and (more := (row := next(rows, None)) is not None):
                        waiting[pool.submit(called, row[1])] = row[0]
                    if waiting:
                        ready, _ = wait(waiting, return_when=FIRST_COMPLETED)
                        yield pd.DataFrame([(waiting.pop(f), *f.result()) for f in ready], columns=[key, "answer", "error", "state"])

    return targets.select(key, text).mapInPandas(run, f"{key} {targets.schema[key].dataType.simpleString()}, answer string, error string, state string")
