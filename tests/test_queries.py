from docketspark.plans import registry
from tests.compare import differences

#: Of these, no rows are expected on the smallest tables.
MAY_BE_EMPTY = {"filter_manager_unknown", "filter_starred_none", "notifications", "insight_spread"}


def test_queries_equal_their_sql(spark, sf_dir):
    queries, sql = registry.queries(), registry.oracle_sql()
    found = differences(spark, sf_dir, list(queries), queries, sql)
    assert {n: d for n, d in found.items() if d[0] not in ("same", "rows only")} == {}
    assert {n for n, d in found.items() if not d[1]} <= MAY_BE_EMPTY
    assert set(queries) - set(sql) == {"chunk_lines"}
