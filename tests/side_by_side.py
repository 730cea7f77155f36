"""Run queries next to their SQL twins: ``python tests/side_by_side.py [sf] [name…]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def twin(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def rows_of(records, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(r[i] for i in order) for r in records), key=repr)


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> str:
    start = time.time()
    df = fn(spark, sf_dir)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    took = time.time() - start
    if sql is None:
        return f"rows {len(got)} {took:.1f}s"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = rows_of(res.fetchall(), cols)
    if sorted(cols) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} {sorted(cols)}"
    if got != want:
        bad = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return f"FAIL {len(got)} rows, want {len(want)}: {bad}"
    return f"ok {len(got)} {took:.1f}s"


if __name__ == "__main__":
    from cohortlens.plans.catalogue import QUERIES, SQL
    from cohortlens.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = twin(sf_dir)
    for name in sys.argv[2:] or list(QUERIES):
        try:
            print(name, compare(spark, con, name, QUERIES[name], SQL.get(name), sf_dir), flush=True)
        except Exception as err:
            print(name, "ERROR", str(err)[:600], flush=True)
