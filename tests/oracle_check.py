"""Compare registered queries with their SQL: ``python tests/oracle_check.py [sf] [name ...]``."""

import datetime
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

DIGITS = int(os.environ.get("CHECK_DIGITS", "9"))


def normal(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.{DIGITS}g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(normal(x) for x in v) + "]"
    try:
        return f"{float(v):.{DIGITS}g}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted([tuple(normal(r[c]) for c in cols) for r in df.select(*cols).collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(normal(r[i]) for i in order) for r in cur.fetchall()])


def compare(spark, con, name, query, sql, sf_dir):
    t = time.time()
    cols, got = spark_rows(query(spark, sf_dir))
    took = time.time() - t
    if sql is None:
        return "rows-only", len(got), took, None
    want_cols, want = duck_rows(con, sql)
    if cols != want_cols:
        return "COLUMNS", len(got), took, (cols, want_cols)
    if got != want:
        a, b = set(got) - set(want), set(want) - set(got)
        return "DIFF", len(got), took, (len(got), len(want), sorted(a)[:2], sorted(b)[:2])
    return "ok", len(got), took, None


if __name__ == "__main__":
    from pressmill.plans import registry
    from pressmill.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.01'}"
    con = duck(sf_dir)
    wanted = sys.argv[2:]
    for name, q in registry.QUERIES.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            status, n, took, info = compare(spark, con, name, q, registry.ORACLES.get(name), sf_dir)
        except Exception as e:
            status, n, took, info = "ERROR", 0, 0, str(e)[:600]
        print(f"{status:9s} {name:28s} rows={n} {took:.1f}s {info or ''}", flush=True)
