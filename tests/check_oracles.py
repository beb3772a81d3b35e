"""Run registered queries against their SQL: python tests/check_oracles.py [sf] [name ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tachyline.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    database = duckdb.connect()
    for table in TABLES:
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return database


def canonical(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for name in frame.columns:
        if str(frame[name].dtype).startswith("datetime"):
            frame[name] = frame[name].astype("datetime64[us]").astype(str)
        else:
            frame[name] = frame[name].map(lambda value: None if pd.isna(value) else repr(value_of(value)))
    return frame.sort_values(list(frame.columns), na_position="first").reset_index(drop=True)


def value_of(value):
    return value.item() if hasattr(value, "item") else value


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} != {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    left, right = canonical(spark_rows), canonical(sql_rows)
    for name in left.columns:
        unequal = ~((left[name] == right[name]) | (left[name].isna() & right[name].isna()))
        if unequal.any():
            at = unequal.idxmax()
            return f"{name}: {int(unequal.sum())} differ, first\n  {left.loc[at].to_dict()}\n  {right.loc[at].to_dict()}"
    return ""


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    chosen = sys.argv[2:] or list(entry.queries())
    spark = build_session(f"local[{os.environ.get('CPUS', 8)}]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    database = connect(sf_dir)
    failures = 0
    for name in chosen:
        started = time.time()
        try:
            got = entry.queries()[name](spark, sf_dir).toPandas()
            took = time.time() - started
            sql = entry.oracle_sql().get(name)
            verdict = "rows only" if sql is None else difference(got, database.execute(sql).df()) or "ok"
        except Exception as error:  # noqa: BLE001
            got, took, verdict = [], time.time() - started, f"{type(error).__name__}: {str(error)[:600]}"
        failures += verdict not in ("ok", "rows only")
        print(f"{name:24s} {len(got):7d} rows {took:6.2f} s  {verdict}", flush=True)
    print(f"{failures} failed of {len(chosen)}")
    return failures


if __name__ == "__main__":
    sys.exit(main())
