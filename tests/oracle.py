"""Run registered queries against their SQL in DuckDB: python tests/oracle.py [sf] [name ...]."""

from __future__ import annotations

import datetime
import glob
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value + 0.0:.9g}"
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return str(value)


def rows(columns: list[str], data) -> list[list]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([[plain(r[i]) for i in order] for r in data])


def compare(spark, con, name: str, build, sql: str | None, sf_dir: str) -> str:
    started = time.time()
    df = build(spark, sf_dir)
    got = rows(df.columns, df.collect())
    took = time.time() - started
    if sql is None:
        return f"ROWS {name}: {len(got)} rows, {took:.1f}s"
    started = time.time()
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows(columns, result.fetchall())
    sql_took = time.time() - started
    if sorted(columns) != sorted(df.columns):
        return f"FAIL {name}: columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        missing = [r for r in want if r not in got][:3] if len(want) < 20000 else []
        extra = [r for r in got if r not in want][:3] if len(got) < 20000 else []
        return f"FAIL {name}: {len(got)} rows, want {len(want)}; missing {missing}; extra {extra}"
    return f"ok   {name}: {len(got)} rows, {took:.1f}s (sql {sql_took:.1f}s)"


def main() -> None:
    import __spark_entry__ as entry
    from conceptstrata.session import build_session

    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{scale}"
    spark = build_session(
        master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    for name, build in entry.queries().items():
        if names and name not in names:
            continue
        try:
            print(compare(spark, con, name, build, sql.get(name), sf_dir), flush=True)
        except Exception as error:  # keep going, one line per query
            print(f"ERR  {name}: {type(error).__name__} {str(error)[:1500]}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
