"""Run queries on Spark and their SQL on DuckDB and compare row by row.

    python tests/compare.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def _key(row):
    return tuple((v is None, str(v)) for v in row)


def rows_of_spark(df):
    names = sorted(df.columns)
    rows = [tuple(_cell(r[n]) for n in names) for r in df.collect()]
    return names, sorted(rows, key=_key)


def rows_of_duck(con, sql):
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(_cell(r[i]) for i in order) for r in cursor.fetchall()]
    return sorted(names), sorted(rows, key=_key)


def difference(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty when equal, else what differs first."""
    names, got = rows_of_spark(query(spark, sf_dir))
    want_names, want = rows_of_duck(con, sql)
    if names != want_names:
        return f"columns {names} against {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return "first different row: " + "; ".join(
                f"{n}: {str(x)[:200]!r} against {str(y)[:200]!r}" for n, x, y in zip(names, a, b) if x != y
            )
    return ""


if __name__ == "__main__":
    import __spark_entry__ as contract
    from corpuslens.session import session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = session(master="local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracle = contract.oracle_sql()
    chosen = sys.argv[2:] or list(oracle)
    for name in chosen:
        began = time.time()
        try:
            result = difference(spark, con, sf, contract.queries()[name], oracle[name])
        except Exception as error:
            result = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{name:26s} {time.time() - began:6.2f}s  {result or 'equal'}", flush=True)
