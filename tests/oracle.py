"""python tests/oracle.py SF NAME...: the queries against their SQL in DuckDB, by sorted rows."""

from __future__ import annotations

import glob
import math
import os
import sys

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings ready_files series_info report_buffers comps tag_dictionary manifest_fragments eval_items".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(names: list[str], rows) -> list[tuple]:
    at = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(_plain(r[k]) for k in at) for r in rows), key=repr)


def differs(spark, con, sf_dir: str, name: str, query, sql: str) -> str | None:
    df = query(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"{name}: columns {df.columns} and {names}"
    if got != want:
        a = [r for r in got if r not in set(want)][:2] if len(got) < 200_000 else []
        b = [r for r in want if r not in set(got)][:2] if len(got) < 200_000 else []
        return f"{name}: {len(got)} rows and {len(want)}; only here {a}, only there {b}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    sf = f"/root/testdata/{sys.argv[1]}"
    spark = SparkSession.builder.master("local[8]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", "/tmp/ckpt").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    con, queries, sqls = connect(sf), e.queries(), e.oracle_sql()
    for name in [n for n in sqls if not sys.argv[2:] or any(n.startswith(p) for p in sys.argv[2:])]:
        t = time.time()
        try:
            said = differs(spark, con, sf, name, queries[name], sqls[name])
        except Exception as x:  # noqa: BLE001
            said = f"{name}: {type(x).__name__} {str(x)[:600]}"
        if said:
            print("BAD", said, flush=True)
        elif time.time() - t > 5:
            print("slow", name, round(time.time() - t, 1), flush=True)
    print("ran", len(sqls))
