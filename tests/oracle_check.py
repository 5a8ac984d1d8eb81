"""Compare queries with their SQL in DuckDB as the driver does: rows, column names and values, in any order.

python tests/oracle_check.py [--sf DIR] [NAME...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings invoice payment benchmark_result flow_summary block_snapshot flow_snapshot flow_event channel_stats eval_item lang_sample pack_spec".split()


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.6g}" if v.as_tuple().exponent else f"{float(v):.6g}"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


def compare(spark, name: str, folder: str, queries: dict, sql: dict) -> str:
    began = time.time()
    df = queries[name](spark, folder)
    rows = df.collect()
    took = time.time() - began
    names = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in names) for r in rows)
    if name not in sql:
        return f"rows-only {len(rows)} rows, {took:.1f} s {df.columns}"
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cur = con.execute(sql[name])
    cols = [c[0] for c in cur.description]
    theirs_rows = cur.fetchall()
    if sorted(cols) != names:
        return f"FAIL columns {sorted(cols)} vs {names}"
    at = [cols.index(c) for c in names]
    theirs = sorted(tuple(plain(r[i]) for i in at) for r in theirs_rows)
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        return f"FAIL rows {len(mine)} vs {len(theirs)}; only here {len(a)} {sorted(a)[:3]}; only there {len(b)} {sorted(b)[:3]}"
    return f"ok {len(rows)} rows, {took:.1f} s"


def main(args: list[str]) -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    folder = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        folder, args = args[1], args[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in args or queries:
        try:
            print(name, compare(spark, name, folder, queries, sql), flush=True)
        except Exception as e:  # noqa: BLE001
            print(name, "ERROR", type(e).__name__, str(e)[:1500], flush=True)


if __name__ == "__main__":
    main(sys.argv[1:])
