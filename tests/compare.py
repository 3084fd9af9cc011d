"""Compare every query that has SQL with DuckDB on the same tables.

python tests/compare.py [sf_dir] [name ...]
"""

import math
import os
import sys
import time
from collections import Counter
from glob import glob

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, query, sql, sf_dir):
    """Empty text if equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} {sorted(rel.columns)}"
    if got != want:
        return f"rows {sum(got.values())} {sum(want.values())}; only here {list((got - want).items())[:3]}; only SQL {list((want - got).items())[:3]}"
    return "" if got else "empty"


if __name__ == "__main__":
    import __spark_entry__ as e
    from pyspark.sql import SparkSession

    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, q, sql = duck(d), e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or list(q):
        t = time.time()
        try:
            if n in sql:
                print(n, compare(spark, con, q[n], sql[n], d) or "ok", f"{time.time() - t:.1f}s", flush=True)
            else:
                print(n, "rows", q[n](spark, d).count(), f"{time.time() - t:.1f}s", flush=True)
        except Exception as x:
            print(n, "ERROR", str(x)[:1500], flush=True)
