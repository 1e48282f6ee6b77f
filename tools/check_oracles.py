"""Compare every query with its SQL: python tools/check_oracles.py [sf_dir] [name ...]"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from paneldrift.plans import ORACLES, QUERIES  # noqa: E402


def normal(v: object) -> object:
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else (v if math.isinf(v) else round(v, 5))
    return v


def sort_key(row: tuple) -> str:
    return repr(row)


def compare(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, folder: str) -> str:
    start = time.time()
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    got = [tuple(normal(r[c]) for c in cols) for r in df.collect()]
    took = time.time() - start
    if name not in ORACLES:
        return f"rows-only {len(got)} rows {took:.2f}s"
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    if sorted(names) != cols:
        return f"COLUMNS {cols} != {sorted(names)}"
    want = [tuple(normal(r[names.index(c)]) for c in cols) for r in cur.fetchall()]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    match = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    typed = [f"{c}: {kinds[c]}/{types[c]}" for c in cols if match.get(kinds[c]) != types[c]]
    got.sort(key=sort_key)
    want.sort(key=sort_key)
    note = f" TYPES {typed}" if typed else ""
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return f"DIFF {len(got)} vs {len(want)} rows {cols} {diff}{note}"
    return f"ok {len(got)} rows {took:.2f}s{note}"


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        table = os.path.basename(f)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{f}'")
    bad = 0
    for name in chosen:
        try:
            result = compare(spark, con, name, folder)
        except Exception as e:  # report and go on with the next query
            result = f"ERROR {type(e).__name__} {str(e)[:600]}"
        bad += not result.startswith(("ok", "rows-only"))
        print(f"{name}: {result}", flush=True)
    print(f"{len(chosen)} queries, {bad} not matching")


if __name__ == "__main__":
    main()
