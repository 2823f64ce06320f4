"""Run queries beside their SQL twins and compare rows, columns and values.

    python check_oracles.py [sf_dir] [query ...]
"""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

from siegeboard.catalog import ORACLES, QUERIES
from siegeboard.session import build_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for name in df.columns:
        df[name] = df[name].map(lambda v: None if v is None or (isinstance(v, float) and v != v) or v is pd.NA or v is pd.NaT else v)
        df[name] = df[name].map(lambda v: repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v))
    return df.sort_values(list(df.columns), ignore_index=True)


def compare(spark, sf_dir: str, name: str) -> str:
    started = time.time()
    got = QUERIES[name](spark, sf_dir).toPandas()
    took = time.time() - started
    if name not in ORACLES:
        return f"rows {len(got)} ({took:.1f}s)"
    base = duckdb.connect()
    for t in TABLES:
        base.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    started = time.time()
    want = base.execute(ORACLES[name]).df()
    sql_took = time.time() - started
    head = f"{len(got)} rows, spark {took:.1f}s, sql {sql_took:.1f}s"
    if sorted(got.columns) != sorted(want.columns):
        return f"COLUMNS {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"ROWS {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    if a.equals(b):
        return f"ok {head}"
    bad = (a != b).any(axis=1)
    cols = [c for c in a.columns if (a[c] != b[c]).any()]
    return f"VALUES differ in {bad.sum()} rows, columns {cols}; {head}\n{a[bad].head(3)}\n{b[bad].head(3)}"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session(
        master="local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        try:
            print(name, "->", compare(spark, sf_dir, name), flush=True)
        except Exception as error:  # keep going, report at the end of the line
            print(name, "-> ERROR", str(error)[:600], flush=True)


if __name__ == "__main__":
    main()
