"""Holds registered queries against their SQL: python tests/compare.py SF_DIR [NAME...]"""

import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def rows_of(frame):
    frame = frame[sorted(frame.columns)]

    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return None
        if hasattr(x, "item"):
            x = x.item()
        return round(x, 6) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def same(spark, con, name, query, sql, sf):
    """None, or what differs."""
    a, b = query(spark, sf).toPandas(), con.sql(sql).df()
    if sorted(a.columns) != sorted(b.columns):
        return f"{name}: columns {sorted(a.columns)} and {sorted(b.columns)}"
    x, y = rows_of(a), rows_of(b)
    if len(x) != len(y):
        return f"{name}: {len(x)} rows and {len(y)}"
    bad = [(p, q) for p, q in zip(x, y, strict=True) if p != q]
    return f"{name}: {len(bad)} of {len(x)} rows differ, as {bad[0]}" if bad else None


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    from quillon import catalogue

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sys.argv[1])
    for name in sys.argv[2:] or catalogue.QUERIES:
        t = time.time()
        try:
            if name in catalogue.SQL:
                differs = same(spark, con, name, catalogue.QUERIES[name], catalogue.SQL[name], sys.argv[1])
                print(f"{time.time() - t:.1f}", differs or f"{name}: same", flush=True)
            else:
                print(name, catalogue.QUERIES[name](spark, sys.argv[1]).count(), "rows, no SQL", flush=True)
        except Exception as e:
            print(name, "FAILED", type(e).__name__, str(e)[:700], flush=True)
