import io
import json
import random
import re
import zipfile

from pyspark.sql import functions as F

from docketspark.functions import exprs as e
from docketspark.functions import text as x
from docketspark.operators import derived, ingest, listing, report, scoring
from docketspark.sources import readers
from docketspark.sources.binding import Tables
from docketspark.sources.snapshots import SnapshotStore
from docketspark.streaming import ingestion, windows


def _one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("v")).first()["v"]


def test_personal_data_before_hangul(spark):
    text = "a\0b 900101-1234567, me@site.kr 01012345678로 +82-10-1234-5678 01012345678a"
    assert _one(spark, e.scrub_pii(F.col("t")), t=text) == "ab [주민번호 제거], [이메일 제거] [전화번호 제거]로 [전화번호 제거] 01012345678a"
    assert _one(spark, e.scrub_pii(F.lit(None).cast("string"))) is None


def test_rounding_and_money(spark):
    assert _one(spark, e.half_up(F.lit(-2.5))) == -2
    assert _one(spark, e.format_won(F.lit(45_000_000))) == "4,500만원"
    assert _one(spark, e.phone_digits(F.lit("+82-10-1234-5678"))) == "01012345678"


def test_lines_keep_their_digits(spark):
    """Characters that are a line's own number stay at its ends; space separators of any kind go, and a missing text has no lines."""
    assert _one(spark, x.split_lines(F.lit("0 ends in 490\n\u00a01 of 11\u3000 \n \u2003\n\tx 33"))) == ["0 ends in 490", "1 of 11", "\tx 33"]
    assert _one(spark, x.split_lines(F.lit(""))) == []
    assert _one(spark, x.split_lines(F.lit(None).cast("string"))) is None


def test_search_moves_no_texts(spark, sf_dir):
    """Words are looked for where the texts are read: behind the scan's projection only flags of the texts go on."""
    t = Tables(spark, sf_dir)
    found = listing.filtered(t.projects, t.timeline, t.bodies, listing.CaseQuery(text="the BUILD"), F.current_timestamp())
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert [line for line in plan if "text#" in line and "Project [" not in line and "Relation [" not in line] == []
    assert sum("text#" in line for line in plan if "Project [" in line) == 1


def _cleaned(md):
    """Headings that nothing filled follows go, round by round, until none does."""
    rank = lambda line: next((r for r, p in ((0, r"\[.*\]$"), (2, r"[0-9]+-[0-9]+\.\s"), (1, r"[0-9]+\.\s")) if re.match(p, line.strip())), None)
    lines = [z for z in md.split("\n") if rank(z) is not None or not re.search(f"{x.ABSENT_END}|{x.ABSENT_LINE}", z.strip())]
    while True:
        filled = [i for i, z in enumerate(lines) if z.strip()]
        behind = {i: rank(lines[n]) if n is not None else -1 for i, n in zip(filled, [*filled[1:], None])}
        empty = {i for i in filled if (r := rank(lines[i])) is not None and behind[i] is not None and behind[i] <= r}
        if not empty:
            return re.sub(r"\n{3,}", "\n\n", "\n".join(z for i, z in enumerate(lines) if i not in empty)).strip()
        lines = [z for i, z in enumerate(lines) if i not in empty]


def test_clean_posting_equals_rounds(spark):
    rng = random.Random(5)
    pool = ["[가]", " [b] ", "1. a", "12. 나", "1-2. c", "3-1. d ", "text", "- 외부 연동 없음", "- 정보 없음.", "미정", "", "  ", "\u3000", "1.", "[x] y"]
    texts = ["\n".join(rng.choices(pool, k=rng.randrange(1, 14))) for _ in range(2000)] + ["", None, "[a]\n" * 100_000, "1. a\n" * 50_000 + "end", "\n" * 100_000 + "x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", x.clean_posting("t").alias("clean"))
    for r in rows.collect():
        want = texts[r.id] if texts[r.id] in (None, "") else "1. a\nend" if r.id == 2003 else _cleaned(texts[r.id])
        assert r.clean == want, texts[r.id][:200]


def test_lines_of_postings_are_trimmed_once(spark):
    """One trim per line however many kinds are tried, and one of the whole; white space of any kind goes at the ends."""
    plan = spark.range(1).select(x.clean_posting(F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("trim(") == 2 and r"\z" not in plan
    assert _one(spark, x.clean_posting(F.lit("\ufeff\u2028[a]\u3000\n\u00a01.\u2003b\n \t\nc\n- 해당  없음 .\x0b\n2. d\n미정\n미정 e\u205f"))) == "[a]\u3000\n\u00a01.\u2003b\n \t\nc\n2. d\n미정 e"


def test_clean_posting(spark):
    md = "[개요]\n1. 목적\n- 쇼핑몰\n2. 범위\n2-1. 화면\n- 미정\n2-2. 관리\n- 정보 없음.\n3. 연동\n- 외부 연동 없음\n[끝]\n"
    assert _one(spark, x.clean_posting(F.lit(md))) == "[개요]\n1. 목적\n- 쇼핑몰\n3. 연동\n- 외부 연동 없음"
    assert _one(spark, x.clean_posting(F.lit(""))) == ""


def test_chunks_restore_the_text():
    text = "\n".join("x" * (i % 50) for i in range(300)) + "\n" + "y" * 500
    parts = list(x.chunks(text, 100))
    assert "\n".join(parts) == text and all(len(p) <= 101 or "\n" not in p for p in parts)


def test_transcript(spark):
    text = "00:01 a: before\n## 전문\n[01:02] 매니저: 안녕: 하세요\n1:02:03 고객: 네\n잡담\n"
    got = _one(spark, x.transcript_lines(F.lit(text)))
    assert [tuple(r) for r in got] == [("01:02", "매니저", "안녕: 하세요"), ("1:02:03", "고객", "네")]


def test_status_rules(spark):
    schema = "id int, status string, is_cancelled int, is_rejected int, date_cancelled string, date_rejected string, has_valid_agreement int, agreement_date_start_progress string, agreement_date_completed string"
    rows = [
        (1, "completed", 1, 0, None, None, 1, None, None), (2, "recruiting", None, None, None, "2024-01-01", 0, None, None), (3, "contracted", 0, 0, "", None, 1, "2024-01-01", "2024-02-01"),
        (4, "contracted", 0, 0, None, None, 1, "2024-01-01", None), (5, "contracted", 0, 0, None, None, 0, None, None), (6, "close_recruiting", 0, 0, None, None, None, None, None), (7, "submitted", 0, 0, None, None, 0, None, None), (8, "frozen", 0, 0, None, None, 0, None, None),
    ]
    got = {r.id: r.s for r in spark.createDataFrame(rows, schema).select("id", ingest.mapped_status().alias("s")).collect()}
    assert got == {1: "완료(취소)", 2: "완료(취소)", 3: "완료(성공)", 4: "진행", 5: "계약", 6: "모집", 7: "검수", 8: None}


def test_cursors(spark):
    rows = spark.createDataFrame([("t1", 9), ("t1", 10), ("t0", 99)], "ts string, id long")
    assert ingest.greatest_cursor(rows, "ts", "id").first()[0] == "t1|10"
    assert ingest.next_cursor("complete", "a", "b", 1) == "a" and ingest.next_cursor("given", "a", None, 0, "m") == "m" and ingest.next_cursor("never", "a", "b") == "a"
    assert ingest.timeline_batch_error(["qna", "note"]) and ingest.timeline_batch_error(["status"]) and not ingest.timeline_batch_error(["qna"])


def test_keyset_pages_give_the_whole_table(spark):
    rows = spark.range(50).select((F.col("id") % 7).alias("ts"), "id")
    seen, after = [], None
    while page := ingest.keyset_page(rows, "ts", "id", after, 9).collect():
        seen += [r.id for r in page]
        after = (page[-1].ts, page[-1].id)
    assert sorted(seen) == list(range(50)) and len(seen) == 50


def test_sums_agree(spark, sf_dir):
    t = Tables(spark, sf_dir)
    total = report.totals(t.projects).first()
    assert total.won + total.cancelled + total.pending == total.total
    semi, anti = (listing.status_filter(t.projects.filter(e.live()), t.timeline, s).count() for s in ("미팅중", "모집"))
    assert semi + anti == t.projects.filter(e.live() & (F.col("status") == "모집")).count()
    once = ingest.upsert(t.previous, t.previous.filter("id % 2 = 0"), ["id"])
    assert once.exceptAll(t.previous).count() == 0 and once.count() == t.previous.count()


def test_score_examples(spark):
    conf = {"purpose": 25, "core_problem": 0, "features": 30, "admin": 0, "users": 60, "platform": 70, "integrations": 20}
    full = dict(purpose=90, core_problem=85, features=90, admin=85, users=70, platform=90, integrations=90, design=70, tech_stack=95, budget=0, timeline=0, deliverables=85)
    rows = [(k, s, c.get(s, 0), True) for k, c in ((1, conf), (2, full)) for s in full]
    rows += [(3, s, c, True) for s, c in (("features", 10), ("purpose", 30), ("admin", 0), ("platform", 50), ("budget", 0))]
    df = spark.createDataFrame(rows, "k int, section string, confidence int, applicable boolean")
    assert {r.k: r.total for r in scoring.totals(df, "k").filter("k < 3").collect()} == {1: 21, 2: 78}
    top = scoring.priorities(df.filter("k = 3"), "k").orderBy("rank").collect()
    assert [(r.section, r.priority) for r in top] == [("features", 18.0), ("purpose", 10.5), ("admin", 10.0)]


def test_estimate_example(spark):
    qty = {"L1": 2, "L2": 2, "L3": 1}
    rows = scoring.rates(spark).withColumn("id", F.lit(1)).withColumn("kind", F.lit("앱")).withColumn("rnd_low", F.lit(0.0)).withColumn("rnd_high", F.lit(None).cast("double"))
    rows = rows.withColumn("qty", F.when(F.col("part") == "dev", F.create_map(*[F.lit(v) for kv in qty.items() for v in kv])[F.col("level")]).otherwise(-3))
    got = scoring.estimate(rows).first()
    assert (round(got.dev_md, 3), round(got.subtotal, 3), round(got.total_low, 3), round(got.total_high, 3)) == (7.0, 315.53, 347.083, 347.083)


def test_plans(spark, sf_dir):
    t = Tables(spark, sf_dir)
    top = listing.board(t.projects.filter(e.live()).withColumn("score", F.lit(0)), t.timeline)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in top
    scan = t.projects.filter(e.live()).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in scan


def test_stream_commits(spark, tmp_path):
    (tmp_path / "in").mkdir()
    batches = [[{"id": 1, "status": "모집", "budget": 5, "modified": "t1"}, {"id": 2, "status": "모집", "budget": 7, "modified": "t1"}], [{"id": 1, "status": "계약", "budget": 5, "modified": "t2"}, {"id": 3, "status": "검수", "budget": None, "modified": "t2"}]]
    store = SnapshotStore(spark, str(tmp_path / "store"))
    schema = "id long, status string, budget long, modified string"
    for i, rows in enumerate(batches):
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        ingestion.run(ingestion.read_batches(spark, str(tmp_path / "in"), schema), store, str(tmp_path / "cp"))
    assert {(r.id, r.status) for r in store.read("cases").collect()} == {(1, "계약"), (2, "모집"), (3, "검수")}
    assert [(r.source_id, r.before, r.after) for r in store.read("events").collect()] == [("1:status:t2", "모집", "계약")]
    assert store.cursor("cases") == "t2|3"
    ingestion.commit_cases(store, spark.createDataFrame([(1, "계약", 5, "t2")], schema))
    assert store.read("events").count() == 1 and store.read("cases").count() == 3


def test_stream_windows_equal_batches(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.write.parquet(str(tmp_path / "events"))
    stream = windows.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("tumbling_test").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("tumbling_test").count() == windows.tumbling(events).count()


def test_readers(spark, tmp_path):
    assert readers.batch_rows('{"rows": [{"a": 1}]}', "k", "k") == (200, [{"a": 1}])
    assert readers.batch_rows("{}", "k", "k")[0] == 400 and readers.batch_rows("{}", "", "k")[0] == 401
    spark.dataSource.register(readers.paged_source(lambda page: [(page * 10 + i, f"p{page}") for i in range(3)]))
    assert spark.read.format("paged").option("pages", "4").load().count() == 12
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="u"><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<w xmlns="u"><row><c t="s"><v>0</v></c><c><v>5</v></c></row></w>')
    (tmp_path / "a.xlsx").write_bytes(buf.getvalue())
    (tmp_path / "b.hwp").write_bytes(b"x")
    (tmp_path / "c.docx").write_bytes(b"broken")
    got = {r.filename: (r.text, r.error is None) for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got["a.xlsx"] == ("name\t5", True) and not got["b.hwp"][1] and not got["c.docx"][1]


def test_refresh_reports_failures(spark):
    def client(text):
        if text == "bad":
            raise ValueError("refused")
        return text.upper()

    rows = spark.createDataFrame([(1, "ok"), (2, "bad")], "id long, text string")
    assert {r.id: (r.answer, r.error) for r in derived.refresh(rows, "id", "text", client).collect()} == {1: ("OK", None), 2: (None, "refused")}
