"""Holds registered queries against their SQL on DuckDB: ``python tests/compare.py DIR [NAME...]``."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def connect(d: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in sorted(Path(d).glob("*.parquet")):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{files}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows(names: list[str], got: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in got)


def differences(spark, c: duckdb.DuckDBPyConnection, d: str, query, sql: str) -> str:
    """Empty if both give the same columns and rows."""
    df = query(spark, d)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    res = c.execute(sql)
    names = [x[0] for x in res.description]
    theirs = rows(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if mine != theirs:
        a, b = set(mine) - set(theirs), set(theirs) - set(mine)
        return f"rows {len(mine)} / {len(theirs)}; only here {len(a)}: {sorted(a)[:3]}; only in SQL {len(b)}: {sorted(b)[:3]}"
    return ""


if __name__ == "__main__":
    import time

    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    c, sql, d = connect(sys.argv[1]), e.oracle_sql(), sys.argv[1]
    for name, q in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        t = time.time()
        try:
            said = differences(spark, c, d, q, sql[name]) if name in sql else f"no SQL; {q(spark, d).count()} rows"
        except Exception as x:  # noqa: BLE001
            said = f"FAILED {str(x)[:1500]}"
        print(f"{name}: {said or 'same'} ({time.time() - t:.1f} s)", flush=True)
