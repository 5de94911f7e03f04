"""Run registered queries on Spark and DuckDB and compare the rows.

    python -m checks.parity SF_DIR [query ...]
"""

from __future__ import annotations

import math
import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def normal(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.10g}"
    if isinstance(value, int):
        return f"{float(value):.10g}"
    return str(value) if not hasattr(value, "as_tuple") else f"{float(value):.10g}"


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


def compare(spark: SparkSession, con, sf_dir: str, run, sql: str | None):
    """(status, seconds on Spark, seconds on DuckDB, note)."""
    started = time.perf_counter()
    frame = run(spark, sf_dir)
    found = frame.collect()
    spark_s = time.perf_counter() - started
    if sql is None:
        return "rows", spark_s, 0.0, f"{len(found)} rows"
    started = time.perf_counter()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    wanted = cursor.fetchall()
    duck_s = time.perf_counter() - started
    if sorted(names) != sorted(frame.columns):
        return "COLUMNS", spark_s, duck_s, f"{sorted(frame.columns)} / {sorted(names)}"
    a, b = rows_of(frame.columns, found), rows_of(names, wanted)
    if a == b:
        return "ok", spark_s, duck_s, f"{len(a)} rows"
    left, right = [r for r in a if r not in set(b)], [r for r in b if r not in set(a)]
    note = f"{len(a)} / {len(b)} rows, {len(left)} / {len(right)} differ"
    for side, rows in (("spark ", left), ("duckdb", right)):
        for row in rows[:2]:
            note += f"\n      {side} {str(row)[:700]}"
    return "DIFF", spark_s, duck_s, note


def session(cores: str = "8") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("aisle-parity")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(sf_dir: str, names: list[str]) -> int:
    from checks.registry import REGISTRY

    spark, con = session(), connect(sf_dir)
    bad = 0
    for name, (run, sql) in REGISTRY.items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            status, spark_s, duck_s, note = compare(spark, con, sf_dir, run, sql)
        except Exception as error:  # report and go on with the next query
            status, spark_s, duck_s, note = "ERROR", 0, 0, str(error)[:1500]
        bad += status not in ("ok", "rows")
        print(f"{status:8} {name:24} spark {spark_s:6.2f}s duckdb {duck_s:6.2f}s  {note}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
