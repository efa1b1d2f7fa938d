"""Run registered queries in Spark and their oracle SQL in DuckDB and compare the results.

Usable from tests and from the command line:

    python tests/oracle_compare.py [sf_dir] [query ...]

Comparison: same column names, same row count, and equal rows after sorting, with values
normalised (timestamps and dates as ISO text, decimals as float).  Floats must be equal
exactly, or -- reported separately -- within 1e-9 relative.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duckdb_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in DRIVER_TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat(sep=" ") if isinstance(v, dt.datetime) else v.isoformat()
    if hasattr(v, "item"):  # numpy scalar
        return _norm(v.item())
    return v


def _key(row):
    return tuple((0, "") if v is None else (1, repr(v)) if isinstance(v, float) else (1, str(v)) for v in row)


def _close(a, b, rel=1e-9):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return math.isclose(float(a), float(b), rel_tol=rel, abs_tol=1e-12)
    return a == b


def compare(spark_df, con, sql: str) -> dict:
    spark_cols = spark_df.columns
    rows = [tuple(_norm(v) for v in r) for r in spark_df.collect()]
    res = con.execute(sql)
    duck_cols = [d[0] for d in res.description]
    drows = [tuple(_norm(v) for v in r) for r in res.fetchall()]
    out = {"spark_rows": len(rows), "oracle_rows": len(drows)}
    if sorted(spark_cols) != sorted(duck_cols):
        out.update(status="schema", spark_cols=spark_cols, oracle_cols=duck_cols)
        return out
    order = sorted(spark_cols)
    si = [spark_cols.index(c) for c in order]
    di = [duck_cols.index(c) for c in order]
    a = sorted((tuple(r[i] for i in si) for r in rows), key=_key)
    b = sorted((tuple(r[i] for i in di) for r in drows), key=_key)
    if len(a) != len(b):
        out.update(status="rowcount")
        return out
    if a == b:
        out.update(status="exact")
        return out
    if all(len(x) == len(y) and all(_close(p, q) for p, q in zip(x, y)) for x, y in zip(a, b)):
        out.update(status="close")
        return out
    bad = [(x, y) for x, y in zip(a, b) if not all(_close(p, q) for p, q in zip(x, y))]
    out.update(status="mismatch", columns=order, first_diff=bad[:3], n_diff=len(bad))
    return out


def main(argv):
    from orderlens.session import get_spark

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    wanted = argv[2:]
    import __spark_entry__ as entry

    spark = get_spark()
    con = duckdb_connection(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = wanted or list(qs)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            if name not in sqls:
                n = df.count()
                print(f"{name:28s} rows-only {n} ({time.time() - t0:.1f}s)")
                continue
            r = compare(df, con, sqls[name])
        except Exception as exc:  # report and go on
            bad += 1
            print(f"{name:28s} ERROR {type(exc).__name__}: {str(exc)[:400]}")
            continue
        if r["status"] not in ("exact", "close"):
            bad += 1
        print(f"{name:28s} {r['status']:9s} spark={r['spark_rows']} oracle={r['oracle_rows']} ({time.time() - t0:.1f}s)")
        if r["status"] not in ("exact",):
            extra = {k: v for k, v in r.items() if k not in ("status", "spark_rows", "oracle_rows")}
            if extra:
                print("    ", str(extra)[:1500])
    spark.stop()
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
