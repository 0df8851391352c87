"""Compare registered queries with their SQL on DuckDB: python tests/check.py [sf_dir] [name-prefix ...]"""

from __future__ import annotations

import os
import sys
import time
import traceback
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def cell(v):
    """Value as text; numbers compare by value, with the last bits of doubles let go unless EXACT is set."""
    if v is None:
        return "NULL"
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        return str(v)
    return repr(float(v)) if os.environ.get("EXACT") else f"{float(v):.9g}"


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"rows-only {len(got)}", bool(got)
    res = con.execute(sql)
    cols = [x[0] for x in res.description]
    want = res.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", False
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a == b:
        return f"ok {len(a)}", True
    sa, sb = set(a), set(b)
    return f"MISMATCH {len(a)} vs {len(b)}; only spark {sorted(sa - sb)[:3]}; only sql {sorted(sb - sa)[:3]}", False


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, q in queries.items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t0 = time.time()
        try:
            note, ok = compare(spark, con, sf_dir, q, sqls.get(name))
        except Exception as e:
            note, ok = "ERROR " + str(e).split("JVM stacktrace")[0][:700], False
            if "-v" in sys.argv:
                traceback.print_exc()
        bad += not ok
        print(f"{'  ' if ok else '!!'} {name} {time.time() - t0:.2f}s {note}", flush=True)
    print("queries", len(queries), "with sql", len(sqls), "bad", bad)


if __name__ == "__main__":
    main()
