"""Spark-vs-DuckDB comparison, the way the driver's correctness gate does it.

Columns are compared by name (sorted), then every row is normalised to a tuple
of comparable values and the two sorted row lists must be equal. Doubles are
compared exactly: both engines compute them from the same exact integers.

CLI: ``python tests/oracle_harness.py [sf_dir] [name ...]``
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

import duckdb

RAW_VIEWS = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in RAW_VIEWS:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, float):
        if math.isnan(v):
            return (1, "nan")
        return (1, repr(float(v)))
    if isinstance(v, decimal.Decimal):
        return (2, str(v.normalize()) if v == v.to_integral() else str(v))
    if isinstance(v, bool):
        return (3, str(v))
    if isinstance(v, int):
        return (3, str(v))
    if isinstance(v, dt.datetime):
        return (4, v.isoformat())
    if isinstance(v, dt.date):
        return (5, v.isoformat())
    return (6, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, sf_dir: str, name: str, queries, oracle, con=None) -> dict:
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = queries[name](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(oracle[name])
    d_cols = [c[0] for c in res.description]
    d_rows = res.fetchall()
    t2 = time.time()
    out = {
        "name": name,
        "spark_rows": len(s_rows),
        "oracle_rows": len(d_rows),
        "columns_match": sorted(s_cols) == sorted(d_cols),
        "spark_sec": round(t1 - t0, 3),
        "oracle_sec": round(t2 - t1, 3),
    }
    out["values_match"] = out["columns_match"] and rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)
    if not out["values_match"]:
        a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
        out["spark_cols"], out["oracle_cols"] = s_cols, d_cols
        out["first_diff"] = next(
            ((x, y) for x, y in zip(a, b) if x != y), (a[len(b):len(b) + 1], b[len(a):len(a) + 1])
        )
    return out


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries

    from mercato.session import build_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 8)
    qs, ora = queries(), oracle_sql()
    names = argv[1:] or list(qs)
    con = duck(sf_dir)
    bad = 0
    for name in names:
        try:
            r = compare(spark, sf_dir, name, qs, ora, con)
        except Exception as exc:  # report and go on with the next query
            r = {"name": name, "error": f"{type(exc).__name__}: {str(exc)[:400]}"}
        ok = r.get("values_match") and r.get("spark_rows") == r.get("oracle_rows")
        bad += not ok
        print(("OK   " if ok else "FAIL ") + str(r), flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
