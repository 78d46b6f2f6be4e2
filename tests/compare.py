"""Run registered queries and their DuckDB statements side by side.

    python tests/compare.py [--sf 0.01] [--only key,key] [--json out.json]
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pyarrow as pa  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def kind(t: pa.DataType) -> str:
    if pa.types.is_integer(t):
        return str(t)
    if pa.types.is_floating(t) or pa.types.is_decimal(t):
        return str(t)
    if pa.types.is_string(t) or pa.types.is_large_string(t):
        return "string"
    if pa.types.is_timestamp(t):
        return "timestamp"
    return str(t)


def shape(table: pa.Table) -> tuple[list, list]:
    names = sorted(table.column_names)
    table = table.select(names)
    columns = [[None if x is None else (repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x)) for x in c.to_pylist()] for c in table.columns]
    rows = sorted(zip(*columns), key=lambda r: tuple((x is None, x or "") for x in r)) if columns else []
    return [(n, kind(table.schema.field(n).type)) for n in names], rows


def compare(spark_table: pa.Table, duck_table: pa.Table) -> str:
    (sa, ra), (sb, rb) = shape(spark_table), shape(duck_table)
    if [n for n, _ in sa] != [n for n, _ in sb]:
        return f"columns: only spark {set(n for n, _ in sa) - set(n for n, _ in sb)}, only duckdb {set(n for n, _ in sb) - set(n for n, _ in sa)}"
    if len(ra) != len(rb):
        return f"rows: {len(ra)} vs {len(rb)}"
    if ra != rb:
        bad = [(x, y) for x, y in zip(ra, rb) if x != y]
        return f"values: {len(bad)} rows differ; {[n for n, _ in sa]} first {bad[0]}"
    if sa != sb:
        return f"types: {[(x, y[1]) for x, y in zip(sa, sb) if x != y]}"
    return "ok"


def main() -> None:
    from pyspark.sql import SparkSession

    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("--only", default="")
    args.add_argument("--json", default="")
    a = args.parse_args()
    import __spark_entry__ as entry

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "10g")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{a.sf}"
    con = duck(folder)
    oracle, todo = entry.oracle_sql(), entry.queries()
    if a.only:
        todo = {k: todo[k] for k in a.only.split(",")}
    report, bad = {}, 0
    for key, fn in todo.items():
        t = time.time()
        try:
            got = fn(spark, folder).toArrow()
            took = time.time() - t
            t = time.time()
            verdict = compare(got, con.execute(oracle[key]).to_arrow_table() if key in oracle else got) if key in oracle else "rows only"
            verdict = verdict if got.num_rows else f"EMPTY {verdict}"
            report[key] = {"verdict": verdict, "rows": got.num_rows, "spark": round(took, 2), "duckdb": round(time.time() - t, 2)}
        except Exception as e:  # noqa: BLE001
            report[key] = {"verdict": f"error: {type(e).__name__} {str(e)[:700]}", "rows": -1, "spark": round(time.time() - t, 2)}
        if report[key]["verdict"] not in ("ok", "rows only"):
            bad += 1
        print(key, report[key], flush=True)
    print(f"{len(report) - bad} of {len(report)} fine; oracles missing for {[k for k in todo if k not in oracle]}")
    if a.json:
        with open(a.json, "w") as f:
            json.dump(report, f, indent=1)


if __name__ == "__main__":
    main()
