"""Holds registered queries against their SQL: python tests/compare.py [--sf DIR] [NAME...].

DuckDB runs in a process of its own, over Parquet files that the Spark process wrote."""

from __future__ import annotations

import math
import os
import shutil
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def rows_of(sf_dir: str, sql: str, result: str) -> tuple[list, list]:
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            path = f"{sf_dir}/{f}" + ("/*.parquet" if os.path.isdir(f"{sf_dir}/{f}") else "")
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{path}')")
    out = []
    for q in (f"SELECT * FROM read_parquet('{result}/*.parquet')", sql):
        got = con.execute(q)
        names = [d[0] for d in got.description]
        order = sorted(range(len(names)), key=lambda k: names[k])
        plain = lambda x: round(x, 9) if isinstance(x, float) and math.isfinite(x) else x
        out.append(([names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in got.fetchall()), key=repr)))
    return tuple(out)


def main() -> int:
    if sys.argv[1:2] == ["--child"]:
        ours, theirs = rows_of(*sys.argv[2:5])
        if ours != theirs:
            print("differ", ours[0], theirs[0], len(ours[1]), len(theirs[1]))
            print([(a, b) for a, b in zip(ours[1], theirs[1]) if a != b][:3])
        return int(ours != theirs)
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.001"
    if args[:1] == ["--sf"]:
        sf_dir, args = args[1], args[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name, sql in entry.oracle_sql().items():
        if args and name not in args:
            continue
        path = tempfile.mkdtemp()
        try:
            entry.queries()[name](spark, sf_dir).write.mode("overwrite").parquet(path)
            done = subprocess.run([sys.executable, __file__, "--child", sf_dir, sql, path], capture_output=True, text=True)
            ok, said = done.returncode == 0, done.stdout + done.stderr[-500:]
        except Exception as e:  # noqa: BLE001
            ok, said = False, str(e)[:700]
        shutil.rmtree(path, ignore_errors=True)
        print("ok  " if ok else "FAIL", name, "" if ok else said, flush=True)
        bad += not ok
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
