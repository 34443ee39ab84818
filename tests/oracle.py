"""Side-by-side check of the registered queries against DuckDB."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if glob.glob(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else (int(v) if v == int(v) and abs(v) < 1e15 else round(v, 6))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if type(v).__name__ == "Decimal":
        return plain(float(v))
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall())


def compare(left, right) -> str:
    if left[0] != right[0]:
        return f"columns {left[0]} vs {right[0]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} vs {len(right[1])}"
    for a, b in zip(left[1], right[1]):
        if a != b:
            return f"value {a} vs {b}"
    return ""


def main(names, sf_dir):
    from tidewatch.catalog import ORACLES, QUERIES
    from tidewatch.session import build_session

    if os.environ.get("PLAIN"):
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", os.environ["PLAIN"]).getOrCreate()
    else:
        spark = build_session("oracle", "local[8]", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    bad = 0
    for name in names or sorted(QUERIES):
        t = time.time()
        try:
            got = spark_rows(QUERIES[name](spark, sf_dir))
            t1 = time.time()
            msg = compare(got, duck_rows(con, ORACLES[name])) if name in ORACLES else f"rows only ({len(got[1])})"
            state = "ok  " if name in ORACLES and not msg else ("rows" if name not in ORACLES else "BAD ")
        except Exception as e:  # report and go on
            t1, state, msg = time.time(), "ERR ", f"{type(e).__name__}: {str(e)[:600]}"
        bad += state in ("BAD ", "ERR ")
        print(f"{state} {name:28s} {t1 - t:6.2f}s {time.time() - t1:6.2f}s {msg}", flush=True)
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args and args[0].startswith("/"):
        sf = args.pop(0)
    main(args, sf)
