"""Compare registered queries with their SQL text on DuckDB.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_norm(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql, check_plan=None):
    t = time.time()
    df = query(spark, sf_dir)
    if check_plan:
        check_plan(df)
    cols, got = _bag(df.columns, [tuple(r) for r in df.collect()])
    compare.spark_seconds = time.time() - t
    cur = con.execute(sql)
    ocols, want = _bag([d[0] for d in cur.description], cur.fetchall())
    if cols != ocols:
        return f"columns {cols} != {ocols}", sum(got.values())
    if got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        return (f"{sum(got.values())} rows vs {sum(want.values())}\n   only spark: {extra}\n   only sql:   {missing}",
                sum(got.values()))
    return None, sum(got.values())


if __name__ == "__main__":
    import __spark_entry__ as entry
    from codestrata import session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = session.build(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                            "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in queries:
        if args and not any(name == a or (a.endswith("*") and name.startswith(a[:-1])) for a in args):
            continue
        t = time.time()
        try:
            if name in sqls:
                err, n = compare(spark, con, sf, queries[name], sqls[name])
            else:
                err, n = None, queries[name](spark, sf).count()
        except Exception as e:  # report and go on
            err, n = f"{type(e).__name__}: {str(e)[:700]}", -1
        bad += err is not None
        print(f"{'FAIL' if err else 'ok  '} {name:24s} {n:7d} rows {time.time() - t:6.2f}s spark {getattr(compare, 'spark_seconds', 0):5.2f}s"
              f"{'' if name in sqls else ' (rows only)'} {err or ''}", flush=True)
    print("failures:", bad)
