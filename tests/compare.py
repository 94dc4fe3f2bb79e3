"""Spark result vs DuckDB oracle comparison, the way the driver's correctness gate does it.

Usage: ``python tests/compare.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def _norm_value(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, pd.Timestamp):
        return v.to_pydatetime().replace(tzinfo=None)
    if isinstance(v, np.ndarray):
        return tuple(_norm_value(x) for x in v.tolist())
    if isinstance(v, (list, tuple)):
        return tuple(_norm_value(x) for x in v)
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "item"):
        return _norm_value(v.item())
    return v


def normalise(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].itertuples(index=False, name=None):
        rows.append(tuple(_norm_value(v) for v in rec))
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark_df: pd.DataFrame, oracle_df: pd.DataFrame) -> tuple[bool, str]:
    if sorted(spark_df.columns) != sorted(oracle_df.columns):
        return False, f"columns differ: {sorted(spark_df.columns)} vs {sorted(oracle_df.columns)}"
    if len(spark_df) != len(oracle_df):
        return False, f"rows differ: spark {len(spark_df)} vs oracle {len(oracle_df)}"
    a, b = normalise(spark_df), normalise(oracle_df)
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return False, f"row {i} differs:\n  spark  {x}\n  oracle {y}"
    return True, f"{len(a)} rows"


def main(argv: list[str]) -> int:
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    only = set(argv[2:])
    from __spark_entry__ import oracle_sql, queries
    from newsprism.session import get_session

    spark = get_session(master="local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    sqls = oracle_sql()
    failed = 0
    for name, fn in queries().items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir).toPandas()
        except Exception as exc:  # report and continue
            print(f"ERROR {name}: spark failed: {type(exc).__name__}: {str(exc)[:400]}")
            failed += 1
            continue
        t1 = time.time()
        if name not in sqls:
            print(f"ROWS  {name}: {len(sdf)} rows (no oracle) spark {t1 - t0:.2f}s")
            continue
        try:
            odf = con.execute(sqls[name]).df()
        except Exception as exc:
            print(f"ERROR {name}: oracle failed: {str(exc)[:400]}")
            failed += 1
            continue
        ok, msg = compare(sdf, odf)
        failed += not ok
        print(f"{'OK   ' if ok else 'FAIL '} {name}: {msg} spark {t1 - t0:.2f}s")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
