"""Run registered queries next to their SQL statements and compare the values.

``python tests/oracle.py [sf] [module-or-name-prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

ROOT = os.environ.get("TESTDATA", "/root/testdata")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def session(cores: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('TEST_CORES', cores)}]").appName("panelforge").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "12g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        f = float(v)
        return 0.0 if f == 0 else f
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, datetime.date) else v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(q, spark, con, folder, check=None):
    """(ok, message) for one query."""
    df = q.run(spark, folder)
    if check is not None:
        check(df._jdf.queryExecution().executedPlan().toString())
    got_names, got = table(df.columns, [tuple(r) for r in df.collect()])
    sql = q.oracle()
    if sql is None:
        return len(got) > 0, f"rows only: {len(got)}"
    res = con.execute(sql)
    want_names, want = table([d[0] for d in res.description], res.fetchall())
    if got_names != want_names:
        return False, f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; {got[:2]} {want[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return False, f"{len(bad)}/{len(got)} differ, {got_names}: {bad[0][0]} != {bad[0][1]}"
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    from panelforge.queries import REGISTRY

    args = sys.argv[1:]
    sf = args[0] if args else "0.01"
    picks = args[1:]
    folder = f"{ROOT}/sf{sf}"
    spark, con = session(), database(folder)
    failed = 0
    for name, q in REGISTRY.items():
        module = q.build.__module__.rsplit(".", 1)[-1]
        if picks and not any(module == p or name.startswith(p) for p in picks):
            continue
        t = time.time()
        try:
            ok, msg = compare(q, spark, con, folder)
        except Exception as e:
            ok, msg = False, f"{type(e).__name__}: {str(e)[:600]}"
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.1f}s {msg}", flush=True)
    print("failed:", failed)
