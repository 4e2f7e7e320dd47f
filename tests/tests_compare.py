"""Run registered queries in Spark and DuckDB and compare columns, types and values.

Usage: python tests/tests_compare.py SF [NAME ...]
"""

from __future__ import annotations

import math
import os
import sys
import tempfile
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
         "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return str(value)


def difference(frame, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    names = sorted(frame.columns)
    rows = frame.select(*names).collect()
    rel = con.sql(sql)
    types = dict(zip(rel.columns, map(str, rel.types)))
    if sorted(types) != names:
        return f"columns {names} != {sorted(types)}"
    for name, kind in frame.dtypes:
        if KINDS.get(kind, kind) != types[name]:
            return f"type of {name}: {kind} != {types[name]}"
    ours = Counter(tuple(map(norm, r)) for r in rows)
    theirs = Counter(tuple(map(norm, r)) for r in rel.project(", ".join(f'"{n}"' for n in names)).fetchall())
    if ours == theirs:
        return None
    return (f"rows {sum(ours.values())} vs {sum(theirs.values())}; columns {names}; "
            f"ours only {list((ours - theirs).items())[:3]}; theirs only {list((theirs - ours).items())[:3]}")


def main(argv: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf = f"/root/testdata/sf{argv[0]}"
    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    con, bad = duck(sf), 0
    for name in argv[1:] or queries:
        started = time.time()
        try:
            if name in oracles:
                problem = difference(queries[name](spark, sf), con, oracles[name])
            else:
                problem = None if queries[name](spark, sf).count() >= 0 else "no rows"
        except Exception as exc:  # report and go on with the other queries
            problem = f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.2f}s"
              f"{'' if name in oracles else ' (rows only)'} {problem or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
