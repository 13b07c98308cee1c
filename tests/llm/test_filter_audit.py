"""The filter audit against DuckDB, a plain walk over odd rows, and its general form."""

from itertools import permutations

import pytest

from docketspark.llm import filter_audit, queries
from tests.compare import differences

LONG = " ".join(f"word{i}" for i in range(120))
ROWS = [
    (1, LONG, "en"), (2, LONG, "en"), (3, LONG, "de"), (4, None, "en"), (5, "", None), (6, "", "en"), (None, LONG, "en"), (7, "A# " * 130, "en"), (7, "A# " * 130, "en"),
    (8, LONG.upper(), "de"), (9, "x " * 200_000, ""), (10, LONG + " $", "fr"), (11, "\x0b\x0c ", "fr"),
]


def plain(rows):
    """{(part, order, step): (kept, removed, redundant, unique)} by walking every document through every order."""
    out = {}
    fails = []
    for doc_id, text, lang in rows:
        text = text or ""
        words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
        flags = {
            "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
            "E": doc_id is not None and any(d is not None and d < doc_id and (t or "") == text for d, t, _ in rows),
        }
        fails.append((lang or "", {f for f, bad in flags.items() if bad}))
    for part in {p for p, _ in fails}:
        for order in permutations("ABCDE"):
            here = [f for p, f in fails if p == part]
            for k, f in enumerate(order):
                first = [min((order.index(x) for x in bad), default=9) for bad in here]
                out[part, "".join(order), k + 1] = (sum(x > k for x in first), sum(x == k for x in first), sum(f in bad and x < k for bad, x in zip(here, first, strict=True)), sum(bad == {f} for bad in here))
    return out


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 1), (2, 0, 0), (7, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_query_equals_sql(spark, sf_dir):
    assert differences(spark, sf_dir, ["op11_filter_audit"], queries.queries(), queries.oracle_sql())["op11_filter_audit"][0] == "same"


def test_odd_rows(spark, labels):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    got = filter_audit.audit_documents(docs, labels).collect()
    want = plain(ROWS)
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails) for r in got} == want
    for r in got:
        f = r.filter_order[r.step - 1]
        assert r.shapley == sum(v[1] for (p, order, step), v in want.items() if p == r.part and order[step - 1] == f)
    # of "en", only E removes document 2 (a label says good, another toxic); 7 is toxic and twice there
    lost = {(r.part, r.filter_order, r.step): (r.good_lost, r.toxic_lost) for r in got}
    assert lost["en", "EABCD", 1] == (1, 1) and lost["en", "EBACD", 2] == (0, 2)


def test_empty_table_and_clashing_columns(spark, labels):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, lang string")
    assert filter_audit.audit_documents(docs.limit(0), labels).count() == 0
    odd = docs.selectExpr("*", "1 AS digest", "2 AS part", "3 AS A", "4 AS `a.b`", "5 AS Text")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(filter_audit.audit_documents(odd, labels)) == rows(filter_audit.audit_documents(docs, labels))


def test_three_filters_of_ones_own(spark):
    flags = spark.createDataFrame([("p", True, False, True, 2), ("p", False, False, True, 3), ("q", True, True, True, 5)], "part string, X boolean, Y boolean, Z boolean, words long")
    got = {(r.part, r.filter_order, r.step): (r.removed, r.words, r.shapley) for r in filter_audit.audit(flags, ("X", "Y", "Z"), ("words",)).collect()}
    assert len(got) == 2 * 6 * 3
    assert got["p", "XYZ", 1] == (1, 2, 3) and got["p", "XYZ", 3] == (1, 3, 9) and got["q", "YXZ", 2] == (0, 0, 2)
    with pytest.raises(ValueError):
        filter_audit.audit(flags, ("X",) * 8)
