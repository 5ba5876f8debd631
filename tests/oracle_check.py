"""Compare registered Spark queries with their DuckDB oracle SQL.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Same shape of check as the driver: row count, column names, and an
order-insensitive comparison of all values.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    import datetime
    import decimal

    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, decimal.Decimal):
        return ("DEC", str(v))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    if sql is None:
        return dict(name=name, ok=None, rows=len(s_rows), sec=round(t1 - t0, 2))
    cur = con.execute(sql)
    d_cols = [c[0] for c in cur.description]
    d_rows = cur.fetchall()
    res = dict(name=name, rows=len(s_rows), oracle_rows=len(d_rows), sec=round(t1 - t0, 2))
    if sorted(s_cols) != sorted(d_cols):
        res.update(ok=False, why=f"columns {sorted(s_cols)} vs {sorted(d_cols)}")
        return res
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if len(a) != len(b):
        res.update(ok=False, why="row count")
        return res
    for ra, rb in zip(a, b):
        if ra != rb:
            cols = sorted(s_cols)
            diff = [(cols[i], ra[i], rb[i]) for i in range(len(ra)) if ra[i] != rb[i]]
            res.update(ok=False, why=f"first diff {diff[:4]}")
            return res
    # type check on a sample row: python types must agree
    for ra, rb in zip(a[:50], b[:50]):
        for x, y in zip(ra, rb):
            if x is not None and y is not None and type(x) is not type(y):
                res.update(ok=False, why=f"type {type(x).__name__} vs {type(y).__name__} ({x!r} / {y!r})")
                return res
    res["ok"] = True
    return res


def main():
    from chainlens.session import get_session
    import __spark_entry__ as E

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = get_session("local[8]", conf={"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, orc = E.queries(), E.oracle_sql()
    bad = 0
    for name in (names or list(qs)):
        try:
            r = compare(spark, con, name, qs[name], orc.get(name), sf_dir)
        except Exception as ex:  # report and continue
            r = dict(name=name, ok=False, why=f"{type(ex).__name__}: {str(ex)[:400]}")
        bad += r.get("ok") is False
        print(r, flush=True)
    print(f"FAILED {bad} of {len(names or qs)}")


if __name__ == "__main__":
    main()
