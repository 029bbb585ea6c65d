"""Run registered queries in Spark and their SQL in DuckDB and compare exactly.

python tests/compare.py [--sf 0.01] [name ...]
"""
from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def session(cpus: int = int(os.environ.get("THAWLINE_CPUS", "8"))):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("thawline")
             .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", os.environ.get("THAWLINE_SHARED", "/tmp/thawline-shared"))
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in rows)


def differences(spark, con, name: str, fn, sql: str, sf_dir: str) -> tuple[str, int]:
    df = fn(spark, sf_dir)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    d_cols, d_rows = rel.columns, rel.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return f"columns {sorted(set(s_cols) ^ set(d_cols))}", len(s_rows)
    if len(s_rows) != len(d_rows):
        return f"rows spark={len(s_rows)} duckdb={len(d_rows)}", len(s_rows)
    a, b = canon(s_rows, s_cols), canon(d_rows, d_cols)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return (f"{len(bad)} of {len(a)} differ, e.g.\n   spark  {bad[0][0]}\n   duckdb {bad[0][1]}" if bad else ""), len(a)


def main(argv):
    sf = "0.01"
    if argv[:1] == ["--sf"]:
        sf, argv = argv[1], argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    import __spark_entry__ as E
    spark, con = session(), duck(sf_dir)
    q, o = E.queries(), E.oracle_sql()
    failed = []
    for name in argv or q:
        t = time.time()
        try:
            if name in o:
                msg, n = differences(spark, con, name, q[name], o[name], sf_dir)
            else:
                n, msg = len(q[name](spark, sf_dir).collect()), ""
        except Exception as e:  # report and go on
            msg, n = f"{type(e).__name__}: {str(e)[:1500]}", -1
        print(f"{'FAIL' if msg else 'ok  '} {name:32s} rows={n} {'' if name in o else '(rows only) '}{time.time() - t:.1f}s {msg}", flush=True)
        if msg:
            failed.append(name)
    print("failed:", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
