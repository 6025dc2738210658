"""Runs registered queries beside their SQL in DuckDB and compares whole results.

python tests/oracle_check.py [--sf DIR] [name or prefix ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def normal_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    cols, rows = normal_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cur = con.execute(sql)
    ocols, orows = normal_rows([c[0] for c in cur.description], cur.fetchall())
    if cols != ocols:
        return f"columns differ: {cols} / {ocols}"
    if len(rows) != len(orows):
        return f"row counts differ: {len(rows)} / {len(orows)}; e.g. {set(rows) - set(orows) and list(set(rows) - set(orows))[:2]} / {list(set(orows) - set(rows))[:2]}"[:900]
    bad = [(a, b) for a, b in zip(rows, orows) if a != b]
    if bad:
        return f"{len(bad)} of {len(rows)} rows differ, e.g. {bad[0]}"[:900]
    return None


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    import __spark_entry__ as entry

    from verdigris.session import build_session

    spark = build_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    oracles, failed, slow = entry.oracle_sql(), 0, []
    for name, fn in entry.queries().items():
        if args.names and not any(name == n or name.startswith(n) for n in args.names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, args.sf)
            if name in oracles:
                problem = compare(df, con, oracles[name])
            else:
                problem = None if df.count() > 0 else "no rows"
        except Exception as exc:
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        took = time.time() - t0
        slow.append((took, name))
        if problem:
            failed += 1
            print(f"FAIL {name} ({took:.1f}s): {problem}", flush=True)
        else:
            print(f"ok   {name} ({took:.1f}s){'' if name in oracles else ' rows only'}", flush=True)
    print("failed:", failed, "slowest:", sorted(slow, reverse=True)[:8])
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
