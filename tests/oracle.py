"""Compare registered queries with their oracle SQL in DuckDB.

``python tests/oracle.py [sf_dir] [prefix ...]`` prints one line per query;
``GROUP_LIMIT=20`` forces the block-wise plans of large groups.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6) + 0.0
    return str(v)


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    pdf = pdf[sorted(pdf.columns)]
    rows = [tuple(_cell(v) for v in r) for r in pdf.itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else what differs."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = rows_of(got), rows_of(want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return f"{x} != {y}"
    return None


def main() -> int:
    from rankpanel.catalog import ORACLES, QUERIES
    from rankpanel.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = build_session("oracle", "8")
    spark.sparkContext.setLogLevel("ERROR")
    if os.environ.get("GROUP_LIMIT"):
        spark.conf.set("spark.rankpanel.maxBroadcastCells", "0")
        spark.conf.set("spark.rankpanel.maxGroupRows", os.environ["GROUP_LIMIT"])
    con = connect(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            if name not in ORACLES:
                print(f"rows  {name} {len(got)} {took:.1f}s", flush=True)
                continue
            diff = compare(got, con.execute(ORACLES[name]).df())
        except Exception as e:  # report and go on
            diff, took = f"{type(e).__name__}: {str(e)[:600]}", time.time() - start
        bad += diff is not None
        print(f"{'ok   ' if diff is None else 'FAIL '} {name} {took:.1f}s {diff or ''}", flush=True)
    print(f"{bad} failed")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
