"""Rules by example, resets, array pairs, and two writers of one store."""

import pytest
from pyspark.sql import functions as F

from docketspark.functions import exprs as e
from docketspark.functions import rules
from docketspark.functions import text as x
from docketspark.operators import derived, ingest, scoring
from docketspark.schema import RISK_TAGS
from docketspark.sources.snapshots import ConcurrentCommit, SnapshotStore


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_quotes_are_compared_without_marks_and_any_white_space(spark):
    assert one(spark, s=e.squash(F.lit("A {b} …[c]　~d-·e; f:")))["s"] == "abcde;f:"
    grounded = one(spark, yes=x.grounded(F.lit("관리자 페이지, 없음!"), F.lit("… 관리자페이지 없음 …")), short=x.grounded(F.lit("a b c"), F.lit("abc")))
    assert (grounded["yes"], grounded["short"]) == (True, False)


@pytest.mark.parametrize(
    ("text", "want"),
    [("김철수: 자료 보냄", "담당자: 자료 보냄"), ("고객사 담당：자료", "고객사 담당：자료"), ("x：  y", "담당자: y"), ("a" * 25 + ": b", "a" * 25 + ": b"), ("no colon", "no colon"), ("a: b\nc", "a: b\nc"), ("a:", "a:"), (None, None)],
)
def test_subjects(spark, text, want):
    assert one(spark, s=x.subject_anonymised(F.lit(text).cast("string")))["s"] == want


def test_inapplicable_needs_evidence(spark):
    source, quote = F.lit("관리자 페이지는 없어도 됩니다."), F.lit("관리자 페이지는 없어도")
    ok = lambda *a: one(spark, r=rules.accepts_inapplicable(*a))["r"]
    yes, no = F.lit(True), F.lit(False)
    assert ok(yes, no, quote, source) and not ok(no, no, quote, source) and not ok(yes, yes, quote, source)
    assert not ok(yes, no, F.lit("지도 기능은 필요 없음"), source) and not ok(yes, no, F.lit(None).cast("string"), source) and not ok(yes, F.lit(None).cast("boolean"), quote, source)


def test_guesses(spark):
    guesses = F.array(*[F.lit(g) for g in ("", " 지도 SDK가 따라오는 편 ", "…가 따라오는 편", "일정 협의 필요함", "b one", "c two", "d three")])
    got = lambda allowed, applies, sure: one(spark, r=rules.accepted_guesses(F.lit(allowed), F.lit(applies), F.lit(sure), guesses))["r"]
    assert got(True, True, 10) == ["지도 SDK가 따라오는 편", "b one", "c two"]
    assert got(False, True, 10) == got(True, False, 10) == got(True, True, 60) == []


def test_all_sections_are_scored(spark):
    answers = spark.createDataFrame([(1, "admin", 70.4, False, "no admin page", ["x y"]), (1, "users", -5.0, True, None, ["구글 로그인이 흔하다"])], "id int, section string, confidence double, applicable boolean, evidence string, guess array<string>")
    sources = spark.createDataFrame([(1, "We need no admin page."), (2, "")], "id int, source string")
    rows = {(r.id, r.section): r for r in scoring.assembled(answers, sources, "id").collect()}
    assert len(rows) == 24 and not rows[1, "admin"].applicable and rows[1, "users"].confidence == 0 and rows[1, "users"].guesses == ["구글 로그인이 흔하다"]
    assert all(r.applicable and r.confidence == 0 for (i, _), r in rows.items() if i == 2)


def test_scored_texts_move_once(spark):
    """Repeated keys meet every answer as a join would, a null key none, and the rows per section carry no text."""
    answers = spark.createDataFrame([(1, "admin", 70.0, False, "no admin page", ["x y"]), (1, "admin", 30.0, None, None, None), (None, "admin", 9.0, False, "no admin page", None)], "id int, section string, confidence double, applicable boolean, evidence string, guess array<string>")
    sources = spark.createDataFrame([(1, "We need no admin page."), (1, "else"), (None, "no admin page"), (2, None)], "id int, source string")
    got = scoring.assembled(answers, sources, "id")
    admin = sorted((str(r.id), r.confidence, r.applicable) for r in got.filter("section = 'admin'").collect())
    assert admin == [("1", 30, True), ("1", 30, True), ("1", 70, False), ("1", 70, True), ("2", 0, True), ("None", 0, True)] and got.count() == 50
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "source#" not in plan[: plan.index("Join Cross")] and "source#" in plan


def test_sources_are_prepared_once(spark):
    """The patterns over a source do not grow with the pairs that are looked up in it."""
    pairs = F.array(*[F.struct(F.lit(f"t{i}").alias("term"), F.lit("p").alias("plain")) for i in range(3)])
    row = one(spark, terms=rules.brief_terms(pairs, F.lit("T1 t 2")), concepts=rules.brief_concepts(pairs, F.lit("T1 t 2")))
    assert [p.term for p in row["terms"]] == ["t1", "t2"] and [p.term for p in row["concepts"]] == ["t0"]
    plan = spark.range(1).select(rules.brief_terms(pairs, F.col("id").cast("string")))._jdf.queryExecution().analyzed().toString()
    assert plan.index("regexp_replace(coalesce(cast(id") < plan.index("filter(")


def test_quantities_labels_and_lists(spark):
    r = one(
        spark, q=F.array(*[rules.quantity(F.lit(v).cast("double")) for v in (2.5, 1.4, -3.0, None)]), k=rules.project_type(F.lit("앱")), p=rules.period(F.lit("  ")), w=rules.question_purpose(F.lit("x")),
        f=F.array(rules.shown_frequency(F.lit(1)), rules.shown_frequency(F.lit(2))), s=rules.scope_list(F.lit(",a,,b")), t=rules.whitelisted(F.array(F.lit(RISK_TAGS[3]), F.lit("?"), F.lit(RISK_TAGS[3])), RISK_TAGS),
        n=rules.full_name(F.lit(" "), F.lit(None).cast("string"), F.lit("acc")), c=rules.chips(F.lit("기획,개발"), F.lit(True), F.lit("idea"), F.lit(3)),
    )
    assert r["q"] == [3, 1, 0, 0] and (r["k"], r["p"], r["w"]) == ("일반 SW", "미정", "범위") and r["f"] == [None, 2]
    assert r["s"] == ["a", "b"] and r["t"] == [RISK_TAGS[3]] and r["n"] == "acc" and r["c"] == ["기획", "개발", "턴키", "아이디어 단계", "지원 3건"]


def test_renewed_answers_empty_their_tags(spark):
    insights = spark.createDataFrame([(1, ["t"], ["c"], "old", "n"), (2, ["t"], ["c"], "old", "n")], "project_id int, risk_tags array<string>, cancel_tags array<string>, qna_summary string, note_extract string")
    new = spark.createDataFrame([(2, "new"), (3, "first")], "project_id int, qna_summary string")
    got = {r.project_id: tuple(r)[1:] for r in derived.renew_questions(insights, new).collect()}
    assert got == {1: (["t"], ["c"], "old", "n"), 2: (None, ["c"], "new", "n"), 3: (None, None, "first", None)}


def test_counts_from_parallel_arrays(spark):
    old = spark.createDataFrame([(1, 5), (2, None), (3, 7)], "id int, proposal_count int")
    batches = spark.createDataFrame([([1, 2, 9], [5, 4, 1]), ([3, 3, None], [8, 2, 1])], "ids array<int>, counts array<int>")
    assert {tuple(r) for r in ingest.update_counts(old, batches).collect()} == {(2, 4), (3, 8)}


def test_foreign_ids_are_dealt_after_the_greatest(spark):
    old = spark.createDataFrame([(5, "a", "x"), (7, "b", "y")], "id long, owner string, v string")
    new = spark.createDataFrame([(5, "a", "new"), (7, "a", "foreign"), (200_000, "a", "far"), (1, "c", "low")], "id long, owner string, v string")
    got = {tuple(r) for r in ingest.upsert_owned(old, new, "id", "owner").collect()}
    assert got == {(5, "a", "new"), (7, "b", "y"), (8, "c", "low"), (9, "a", "foreign"), (10, "a", "far")}


def test_two_writers_of_a_version(spark, tmp_path):
    first, second = (SnapshotStore(spark, str(tmp_path / "s")) for _ in range(2))
    rows = spark.range(3)
    assert first.commit({"t": rows}) == 1
    stale = second.manifest()
    assert first.commit({"t": rows}, {"c": "2"}) == 2
    second.manifest = lambda: stale
    with pytest.raises(ConcurrentCommit):
        second.commit({"t": rows.limit(1)})
    assert first.read("t").count() == 3 and first.cursor("c") == "2"
    with pytest.raises(AttributeError):
        first.commit({"t": None})
    assert first.commit({"t": rows.limit(2)}) == 3
