"""Run queries next to their SQL in DuckDB and compare: `python tests/check_queries.py [sf] [names]`."""
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry
from geoweft import catalogue


def cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "item"):
        return cell(v.item())
    if isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    if type(v).__name__ == "Decimal":
        return round(float(v), 6)
    return v


def table(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf, name):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    start = time.time()
    df = entry.queries()[name](spark, sf)
    mine = table(df.columns, df.collect())
    took = time.time() - start
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"ran  {name}: {len(mine[1])} rows", took
    res = con.execute(sql)
    theirs = table([d[0] for d in res.description], res.fetchall())
    if mine == theirs:
        return f"ok   {name}: {len(mine[1])} rows", took
    if mine[0] != theirs[0]:
        return f"COLS {name}: {mine[0]} / {theirs[0]}", took
    a, b = set(mine[1]), set(theirs[1])
    return f"DIFF {name}: {len(mine[1])} / {len(theirs[1])} rows, ours {sorted(a - b, key=repr)[:3]}, theirs {sorted(b - a, key=repr)[:3]}", took


if __name__ == "__main__":
    sf = f"/root/testdata/sf{sys.argv[1] if len(sys.argv) > 1 else '0.001'}"
    names = sys.argv[2].split(",") if len(sys.argv) > 2 else [n for n in entry.queries() if n in catalogue.QUERIES]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    for n in names:
        try:
            line, took = compare(spark, sf, n)
        except Exception as e:
            line, took = f"FAIL {n}: {type(e).__name__} {str(e)[:600]}", 0
        print(f"{took:6.1f}s {line}", flush=True)
