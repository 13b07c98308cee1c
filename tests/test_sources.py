"""The cursor stream over a database file, and calls under a bound and a deadline."""

import datetime
import sqlite3
import threading
import time

from docketspark.functions import text as x
from docketspark.operators import derived
from docketspark.sources import readers


def source(path, hot_edge):
    predicate = readers.keyset_sql("ts", "id")

    def rows(after, upto, part, parts):
        with sqlite3.connect(path) as db:
            yield from db.execute(f"SELECT id, ts, v FROM t WHERE {predicate}", (after[0], after[0], after[1], upto[0], upto[0], upto[1], parts, part)).fetchall()

    def newest():
        with sqlite3.connect(path) as db:
            return db.execute("SELECT ts, id FROM t WHERE ts < ? ORDER BY ts DESC, id DESC LIMIT 1", (hot_edge,)).fetchone()

    return readers.cursor_source("id long, ts string, v string", rows, newest)


def test_restarts_read_every_row_once(spark, tmp_path):
    path, seen = str(tmp_path / "db"), []
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER, ts TEXT, v TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(i, "2024-01-01 00:00:0" + str(i // 40), "a") for i in range(100)])

    def drain(edge):
        spark.dataSource.register(source(path, edge))
        stream = spark.readStream.format("cursor").option("partitions", "3").load()
        q = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: seen.extend((r.id, r.ts, r.v) for r in df.collect())).start()
        q.awaitTermination()

    drain("2024-01-01 00:00:02")  # the newest seconds may still change
    assert sorted(i for i, *_ in seen) == list(range(80))
    with sqlite3.connect(path) as db:
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(200, "2024-01-01 00:00:02", "same time"), (201, "2024-01-01 00:00:03", "b")])
        db.execute("UPDATE t SET ts = '2024-01-01 00:00:04', v = 'again' WHERE id = 7")
    drain("2024-01-01 00:00:09")
    drain("2024-01-01 00:00:09")
    assert sorted(i for i, *_ in seen) == sorted([*range(100), 7, 200, 201]) and (7, "2024-01-01 00:00:04", "again") in seen


def test_rows_behind_a_cursor_of_a_relational_source(spark, monkeypatch):
    asked = {}
    monkeypatch.setattr(type(spark.read), "jdbc", lambda self, url, table, predicates, properties: asked.update(url=url, predicates=predicates, **properties))
    readers.read_changed(spark, "jdbc:x", "t", "ts", "id", ("2024-01-01", 7), partitions=2, user="u")
    assert asked["predicates"] == ["(ts > '2024-01-01' OR (ts = '2024-01-01' AND id > 7)) AND MOD(id, 2) = 0", "(ts > '2024-01-01' OR (ts = '2024-01-01' AND id > 7)) AND MOD(id, 2) = 1"] and asked["user"] == "u"
    readers.read_changed(spark, "jdbc:x", "t", "ts", "id", None, partitions=1)
    assert asked["predicates"] == ["1 = 1 AND MOD(id, 1) = 0"]


def test_calls_are_bounded_and_stop_at_the_deadline(spark, tmp_path):
    log = str(tmp_path / "calls")

    def slow(text):
        with open(log, "a") as f:
            f.write(f"+{threading.get_ident()} {time.time()}\n")
        time.sleep(0.3)
        with open(log, "a") as f:
            f.write(f"- {time.time()}\n")
        if text == "3":
            raise ValueError("refused")
        return text * 2

    rows = spark.range(12).selectExpr("id", "string(id) AS text").coalesce(1)
    got = {r.id: (r.answer, r.error, r.state) for r in derived.refresh(rows, "id", "text", slow, concurrency=3).collect()}
    assert len(got) == 12 and got[3] == (None, "refused", "failed") and got[4] == ("44", None, "done")
    under_way = most = 0
    for line in open(log):
        under_way += 1 if line[0] == "+" else -1
        most = max(most, under_way)
    assert 1 < most <= 3
    began = datetime.datetime.now()
    late = derived.refresh(spark.range(400).selectExpr("id", "string(id) AS text").coalesce(1), "id", "text", slow, concurrency=2, seconds=4).collect()
    assert len({r.id for r in late}) == len(late) == 400 and (datetime.datetime.now() - began).total_seconds() < 30
    assert {r.state for r in late} <= {"done", "failed", "not started"} and sum(r.state == "not started" for r in late) > 300
    none = derived.refresh(rows, "id", "text", slow, seconds=0).collect()
    assert {r.state for r in none} == {"not started"} and len(none) == 12


def test_headings_are_filled(spark):
    rows = spark.createDataFrame([(1, "a", "text"), (1, "c", "  "), (2, "b", "x")], "k int, heading string, body string")
    got = {(r.k, r.position): (r.heading, r.body) for r in x.headings_filled(rows, "k", "heading", "body", ("a", "b", "c")).collect()}
    assert got == {(1, 0): ("a", "text"), (1, 1): ("b", "-"), (1, 2): ("c", "-"), (2, 0): ("a", "-"), (2, 1): ("b", "x"), (2, 2): ("c", "-")}
