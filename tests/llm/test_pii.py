"""Personal data against a plain version of the base kinds, and the kinds the method adds."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from docketspark.llm import pii
from docketspark.llm.queries import op6_pii

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(x) if i % 2 == 0 else sum(divmod(2 * int(x), 10)) for i, x in enumerate(d[::-1])) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub(r"\D", "", m.group(), flags=re.ASCII)
            if kind == "email" or kind == "ip" and all(int(p) < 256 for p in m.group().split(".")) or kind == "card" and 13 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_query_equals_brute_force(spark, sf_dir):
    for sf in (sf_dir, "/root/testdata/sf0.01"):
        docs = {r.doc_id: brute(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        rows = op6_pii(spark, sf).collect()
        assert len(rows) == len(docs)
        for r in rows:
            want = docs[r.doc_id]
            assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w.startswith(k) for w in want) for k in BASE]
            assert set(want) <= set(r.spans.split(","))  | {""}


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("ab.@-+%_ ()0123456789é\n"), max_size=60))
def test_base_kinds_of_any_text(text):
    assert [f"{k}:{s}:{e}" for k, s, e, _, base, _ in pii.find_spans(text) if base] == brute(text)


def test_validators_and_context():
    kinds = lambda t: [(k, x) for k, _, _, _, _, x in pii.find_spans(t)]
    assert kinds("pay to DE89 3704 0044 0532 0130 00 now") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert kinds("pay to DE88 3704 0044 0532 0130 00 now") == []
    assert kinds("her social security number 123-45-6789") == [("ssn", "123-45-6789")]
    assert kinds("part 123-45-6789") == [] and kinds("number 123-45-6789") == []
    assert kinds("call 555-123-4567 today") == [("local_phone", "555-123-4567")]
    assert kinds("size 555-123-4567") == []
    assert kinds("4111 1111 1111 1111") == [("card", "4111 1111 1111 1111")] and kinds("4111 1111 1111 1112") == []
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")
    assert pii.resident_number("9001011234568") == (((11 - sum(w * int(d) for w, d in zip((2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5), "900101123456", strict=True)) % 11) % 10) == 8)
    high, low = (pii.find_spans(t)[0][3] for t in ("our server 10.0.0.1", "version 10.0.0.1"))
    assert high > low


def test_edge_cases(spark):
    rows = [(None, None), (1, ""), (1, "é \U0001f600 a@b.co"), (1, "é \U0001f600 a@b.co"), (2, "x " * 200000 + "+1 (017) 555-7713")]
    docs = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, spans int, kind string")
    got = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.spans]) for r in pii.personal_data(docs).collect()), key=str)
    assert got == sorted([(None, []), (1, []), (1, [("email", 4, 10)]), (1, [("email", 4, 10)]), (2, [("phone", 400000, 400017)])], key=str)
    assert pii.personal_data(docs.limit(0)).count() == 0
