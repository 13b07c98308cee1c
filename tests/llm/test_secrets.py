import hashlib
import re

import pytest
from pyspark.sql import functions as F

from docketspark.llm import secrets

HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, value string, Score int, `a.b` int, __text int"


def examples(spark, n):
    words = spark.createDataFrame([(w,) for w in secrets.PLAIN_WORDS], "word string")
    return secrets.with_coverage(secrets.materialize(secrets.example_findings(spark, n), "test-examples"), words)


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(examples(spark, 2000))


def _rows(*texts):
    return [(i, t, "en", "src0", None if t is None else len(t), "kept", 1, 2, 3) for i, t in enumerate(texts)]


def test_places_equal_a_plain_search(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {(r.doc_id, r.start, r.end, r.value) for r in secrets.candidates(docs, "text", ["doc_id"]).collect()}
    want, prefix = set(), re.compile(secrets._PREFIX.replace("^(?i:", "(?i:"))
    for r in docs.select("doc_id", "text").collect():
        for m in re.finditer(secrets.CANDIDATE, r.text or ""):
            skip = len(p[0]) if (p := prefix.match(m[0])) else 0
            want.add((r.doc_id, m.start() + skip, m.end(), m[0][skip:]))
    assert got == want and got


def test_edge_cases_and_redaction(spark, model):
    long = "word " * 60_000 + f'token = "{HEX}" end'
    texts = [None, "", f'a ß𝄞 token = "{HEX}" b', "card 4012888888881881 of", long, f'token = "{HEX}"', f'x token = "{HEX}" y token = "{HEX}"', "a" * 200_000]
    docs = spark.createDataFrame(_rows(*texts) + _rows(*texts)[2:3] + [(None, texts[5], None, None, None, None, None, None, None)], SCHEMA)
    found = secrets.report(docs, model)
    assert found.count() == docs.count()
    by_id = {r.doc_id: r for r in found.collect()}
    assert by_id[0].n_candidates == by_id[1].n_candidates == by_id[7].n_candidates == 0
    assert [(s.start, s.end) for s in by_id[2].secrets] == [(14, 54)]
    assert by_id[3].n_candidates == 1 and by_id[3].n_secrets == 0
    assert [(s.start, s.end) for s in by_id[4].secrets] == [(300_009, 300_049)]
    assert by_id[6].n_secrets == 2 and by_id[None].n_secrets == 1
    out = secrets.redact(docs, model)
    assert out.columns == docs.columns and out.count() == docs.count()
    texts_out = {r.doc_id: r.text for r in out.collect()}
    assert texts_out[2] == 'a ß𝄞 token = "[secret]" b' and texts_out[3] == texts[3] and texts_out[0] is None and texts_out[1] == ""
    assert texts_out[6] == 'x token = "[secret]" y token = "[secret]"' and texts_out[4].endswith('token = "[secret]" end')
    empty = docs.limit(0)
    assert secrets.report(empty, model).count() == 0 and secrets.redact(empty, model).count() == 0


def test_held_out_rows(spark, model):
    """Rows that the forest has not seen; a digest in prose without any name stays open to either reading."""
    held = examples(spark, 6000).filter("form <> 'hex_in_prose'").join(examples(spark, 2000).select("value"), "value", "left_anti")
    scored = model.transform(secrets.with_features(held))
    right = scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert right > 0.97


def test_held_out_forms(spark):
    """Whole forms that the forest was not trained on: recall of the secrets, precision by the share of harmless ones left alone."""
    rows = secrets.materialize(examples(spark, 4000), "test-forms")
    held = ("github", "base64", "password", "uuid", "path", "account")
    model = secrets.train(rows.filter(~F.col("form").isin(*held)))
    scored = model.transform(secrets.with_features(rows.filter(F.col("form").isin(*held))))
    found = {(r.form, r.label): r.share for r in scored.groupBy("form", "label").agg(F.avg("prediction").alias("share")).collect()}
    assert min(found["github", 1], found["base64", 1]) > 0.95 and found["password", 1] > 0.8
    assert max(found["uuid", 0], found["path", 0], found["account", 0]) < 0.1


def test_a_digest_in_prose_is_left_alone(spark, model):
    docs = spark.createDataFrame(_rows(f"the first river {HEX} ran over", f'the token = "{HEX}" ran over'), SCHEMA)
    assert {r.doc_id: (r.n_candidates, r.n_secrets) for r in secrets.report(docs, model).collect()} == {0: (1, 0), 1: (1, 1)}


def test_dictionary_counts_documents(spark):
    docs = spark.createDataFrame([(1, "alpha beta, alpha"), (2, "ALPHA 12gamma"), (3, "alpha (beta)"), (4, None)], "doc_id long, text string")
    assert {r.word for r in secrets.dictionary(docs, min_docs=3).collect()} == {"alpha"}
    only = spark.createDataFrame([("alpha",), ("gamma",)], "word string")
    assert {r.word for r in secrets.dictionary(docs, min_docs=1, only=only).collect()} == {"alpha"}


def test_words_of_the_corpus_are_learnt(spark):
    text = "the silver morning brought another letter to harbour street with id=ab12cd34ef56ab78 on the silver morning"
    docs = spark.createDataFrame(_rows(*[text] * 5, None, ""), SCHEMA)
    found = secrets.candidates(docs, "text", ["doc_id"])
    assert {"harbour", "morning", "silver", "street"} <= set(secrets.example_words(found)) and len(secrets.example_words(found)) == secrets.WORDS
    assert secrets.report(docs).count() == 7


def test_no_python_in_the_plan(spark, sf_dir, model):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plan = secrets.redact(docs, model)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_unquoted_assignments_to_any_name(spark, model):
    mixed = "Zq8Lw3nTf0Yc5RbK2vXh7MdJ9sPa4GeU6iQo"
    found = ["aws_access_key_id=AKIAIOSFODNN7QWERTY", f"GITHUB_PAT=ghp_{mixed}", f"STRIPE=sk_live_{mixed[:24]}", f"token_v2={HEX}", f"db_pass={mixed[:6]}!{mixed[6:12]}", f"https://www.host.org/get?user=bob&sig={HEX}", f"my_service_token_v2={HEX}", f"BOT=xoxb-123456789012-{mixed[:24]}"]
    harmless = ["https://www.host.org/list?order=4012888888881881", "version=river-report-1987", f"commit={HEX}", "path=docs/summer-letter-2001", "page=12345678"]
    docs = spark.createDataFrame(_rows(*[f"first line\n{t}\nlast line" for t in found + harmless]), SCHEMA)
    by_id = {r.doc_id: r for r in secrets.report(docs, model).collect()}
    texts = {r.doc_id: r.text for r in secrets.redact(docs, model).collect()}
    for i, line in enumerate(found):
        start = 11 + line.rindex("=") + 1
        assert (start, 11 + len(line)) in [(s.start, s.end) for s in by_id[i].secrets], line
        assert texts[i] == f"first line\n{line[: line.rindex('=') + 1]}[secret]\nlast line"
    for i, line in enumerate(harmless, len(found)):
        assert by_id[i].n_candidates and not by_id[i].n_secrets, line


def test_very_many_candidates_in_one_text(spark, model):
    """Places and redaction of 50,000 candidates in one text, against a plain search."""
    lines = [f'token = "{hashlib.sha1(b"%d" % i).hexdigest()}" of ß𝄞 {i}' if i % 2 else f"order {10**15 + i} is on its way" for i in range(50_000)]
    text = "\n".join(lines)
    docs = spark.createDataFrame(_rows(text, "nothing here") + _rows(text)[:1], SCHEMA)
    found = secrets.candidates(docs, "text", ["doc_id"]).collect()
    want = [(m.start() + len(p[0]) if (p := re.match(secrets._PREFIX, m[0])) else m.start(), m.end()) for m in re.finditer(secrets.CANDIDATE, text)]
    assert [(r.place, r.start, r.end) for r in sorted(found, key=lambda r: r.place)] == [(i, *w) for i, w in enumerate(want)] and len(want) == 50_000
    spans = [r.secrets for r in secrets.report(docs, model).filter("doc_id = 0").collect()]
    assert len(spans) == 2 and spans[0] == spans[1] and len(spans[0]) >= 24_000
    out, at = [], 0
    for s in spans[0]:
        out += [text[at : s.start], secrets.MARK]
        at = s.end
    clean = [r.text for r in secrets.redact(docs, model).filter("doc_id = 0").collect()]
    assert clean == ["".join(out) + text[at:]] * 2
