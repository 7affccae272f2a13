"""Compare registered queries with their SQL: ``python -m oracles.check <sf_dir> [name ...]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

from oracles import all_sql
from threatlake.plans import load_queries
from threatlake.session import build_session


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir, name, run, sql) -> str:
    df = run(spark, sf_dir)
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = canonical(rel.columns, rel.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} vs {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} vs {len(want[1])}"
    kinds = {c: t for c, t in df.dtypes}
    other = {c: str(t) for c, t in zip(rel.columns, rel.types)}
    names = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {c: (k, other[c]) for c, k in kinds.items() if names.get(k) != other[c]}
    bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ, e.g. {got[0]} {bad[0][0]} vs {bad[0][1]}"
    return f"ok {len(got[1])}" + (f" types {odd}" if odd else "")


def main() -> None:
    sf_dir = sys.argv[1]
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, names = connect(sf_dir), all_sql(), sys.argv[2:]
    for name, run in load_queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        began = time.time()
        try:
            if name in sql:
                result = compare(spark, con, sf_dir, name, run, sql[name])
            else:
                result = f"no sql, {run(spark, sf_dir).count()} rows"
        except Exception as error:  # noqa: BLE001
            result = "ERROR " + str(error)[:600]
        flag = "" if result.startswith(("ok", "no sql")) else "  <<<<"
        print(f"{name:28s} {time.time() - began:6.1f}s {result}{flag}", flush=True)


if __name__ == "__main__":
    main()
