"""Runs registered queries next to their SQL: ``python tests/check_queries.py [sf] [names...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
import pandas as pd

import __spark_entry__ as entry
from calibrel.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and pd.isna(value)):
        return None
    if isinstance(value, float):
        return float(f"{value:.10g}")
    if hasattr(value, "item"):
        return plain(value.item())
    return value


def rows_of(columns, records) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def compare(spark, con, name: str, sf_dir: str) -> tuple[int, str]:
    result = entry.queries()[name](spark, sf_dir)
    found = rows_of(result.columns, result.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(found), "no SQL"
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    wanted = rows_of(columns, cursor.fetchall())
    if sorted(columns) != sorted(result.columns):
        return len(found), f"columns {sorted(result.columns)} against {sorted(columns)}"
    if found == wanted:
        return len(found), "ok"
    differing = [p for p in zip(found, wanted) if p[0] != p[1]][:1]
    return len(found), f"{len(found)} rows against {len(wanted)}, first: {str(differing)[:600]}"


def main() -> None:
    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    spark, con = build_session(8), connect(sf_dir)
    bad = 0
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            count, verdict = compare(spark, con, name, sf_dir)
        except Exception as error:
            count, verdict = -1, f"failed: {str(error)[:800]}"
        bad += verdict != "ok"
        print(f"{name:28s} {count:7d} rows {time.time() - start:6.2f}s  {verdict}", flush=True)
    print(f"{bad} not ok")


if __name__ == "__main__":
    main()
