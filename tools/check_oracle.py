"""Run registered queries next to their SQL and report differences.

    python tools/check_oracle.py [-d DIR] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loadscope.catalog import ORACLES, QUERIES  # noqa: E402
from loadscope.session import local_session  # noqa: E402


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.10g}")
    if hasattr(value, "asDict"):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda c: columns[c])
    picked = [tuple(plain(r[c]) for c in order) for r in rows]
    return [columns[c] for c in order], sorted(picked, key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for file in sorted(os.listdir(sf_dir)):
        if file.endswith(".parquet"):
            con.execute(f"create view {file[:-8]} as select * from '{sf_dir}/{file}'")
    return con


def compare(spark, con, sf_dir, name):
    """None when equal, else a description; the second value is seconds in Spark."""
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got_cols, got = table(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if name not in ORACLES:
        return (None if got else "no rows"), took, len(got)
    cur = con.execute(ORACLES[name])
    want_cols, want = table([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} / {want_cols}", took, len(got)
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}", took, len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} differ, e.g.\n   {str(bad[0][0])[:600]}\n   {str(bad[0][1])[:600]}", took, len(got)
    return None, took, len(got)


def main():
    parser = argparse.ArgumentParser()
    parser.add_argument("names", nargs="*")
    parser.add_argument("-d", "--dir", default="/root/testdata/sf0.01")
    args = parser.parse_args()
    spark = local_session(8, **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g",
                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.dir)
    failed = []
    names = [n for n in QUERIES if not args.names or any(n.startswith(a) for a in args.names)]
    for name in names:
        try:
            problem, took, rows = compare(spark, con, args.dir, name)
        except Exception as err:  # noqa: BLE001 - report and go on
            problem, took, rows = f"{type(err).__name__}: {str(err)[:1500]}", 0.0, -1
        kind = "sql " if name in ORACLES else "rows"
        print(f"{'FAIL' if problem else 'ok  '} {kind} {took:6.2f}s {rows:7d} {name} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} agree; failed: {failed}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
