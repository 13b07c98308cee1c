"""Runs registered queries beside their SQL and compares rows without regard to order."""

import datetime
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return None if math.isnan(v) else round(float(v), 6)
    if isinstance(v, int):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(_value, v))
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, sf_dir, names, queries, sql):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    out = {}
    for name in names:
        try:
            df = queries[name](spark, sf_dir)
            got = _rows(df.columns, df.collect())
            if name not in sql:
                out[name] = ("rows only", len(got[1]))
                continue
            rel = con.sql(sql[name])
            want = _rows(rel.columns, rel.fetchall())
        except Exception as ex:  # noqa: BLE001
            out[name] = ("error", f"{type(ex).__name__}: {str(ex)[:600]}")
            continue
        if got[0] != want[0]:
            out[name] = ("columns", got[0], want[0])
        elif got[1] != want[1]:
            bad = [(a, b) for a, b in zip(got[1], want[1], strict=False) if a != b][:2]
            out[name] = ("rows", len(got[1]), len(want[1]), bad)
        else:
            out[name] = ("same", len(got[1]))
    return out
