"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(repr(value))
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """(problem or None, row count, Spark seconds, DuckDB seconds)."""
    start = time.time()
    df = fn(spark, sf_dir)
    rows = df.collect()
    spark_s = time.time() - start
    if sql is None:
        return None, len(rows), spark_s, 0.0
    start = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    duck_s = time.time() - start
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}", len(rows), spark_s, duck_s
    got_rows, want_rows = rows_of(df.columns, rows), rows_of(names, want)
    if got_rows != want_rows:
        extra = list((got_rows - want_rows).elements())[:3]
        missing = list((want_rows - got_rows).elements())[:3]
        return (
            f"{sorted(names)}: {len(rows)} vs {len(want)} rows\n  spark only {str(extra)[:900]}\n  sql only {str(missing)[:900]}",
            len(rows), spark_s, duck_s,
        )
    return None, len(rows), spark_s, duck_s


if __name__ == "__main__":
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from reviewlake.session import local_session

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    if os.environ.get("PLAIN"):  # a session with Spark's own defaults
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.master("local[8]").getOrCreate()
    else:
        spark = local_session(8)
    con = connect(sf)
    bad = 0
    for key, fn in queries().items():
        if wanted and key not in wanted:
            continue
        try:
            problem, n, a, b = compare(spark, con, key, fn, oracle_sql().get(key), sf)
        except Exception as e:  # report and go on with the next query
            problem, n, a, b = f"{type(e).__name__}: {str(e)[:1500]}", 0, 0, 0
        bad += problem is not None
        mark = "FAIL" if problem else ("ok" if oracle_sql().get(key) else "rows")
        print(f"{mark:5}{key:24} rows {n:7} spark {a:6.2f}s duckdb {b:6.2f}s", problem or "", flush=True)
    print("failed:", bad)
