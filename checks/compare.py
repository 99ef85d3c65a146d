"""Run queries and their SQL side by side: ``python -m checks.compare [name ...]``."""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb
from pyspark.sql import SparkSession

from checks import ALL_ORACLES, ALL_QUERIES


def local_session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    duck = duckdb.connect()
    for name in sorted(os.listdir(sf_dir)):
        table = name.removesuffix(".parquet")
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return duck


def difference(query_rows, query_columns, oracle_rows, oracle_columns) -> str | None:
    """What differs between two results, regardless of row and column order."""
    if sorted(query_columns) != sorted(oracle_columns):
        return f"columns {sorted(query_columns)} != {sorted(oracle_columns)}"

    def normal(rows, columns):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted((tuple(row[i] for i in order) for row in rows), key=repr)

    ours, theirs = normal(query_rows, query_columns), normal(oracle_rows, oracle_columns)
    if len(ours) != len(theirs):
        sample = [row for row in ours if row not in set(theirs)][:2], [row for row in theirs if row not in set(ours)][:2]
        return f"{len(ours)} rows != {len(theirs)} rows; only here {sample[0]}, only there {sample[1]}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows differ: {wrong[0]}"
    return None


def compare(spark: SparkSession, duck, name: str, sf_dir: str) -> str | None:
    frame = ALL_QUERIES[name](spark, sf_dir)
    rows = [tuple(row) for row in frame.collect()]
    if name not in ALL_ORACLES:
        return None
    result = duck.execute(ALL_ORACLES[name])
    columns = [item[0] for item in result.description]
    return difference(rows, frame.columns, result.fetchall(), columns)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.01")
    spark, duck = local_session(), duck_connection(sf_dir)
    failed = []
    for name in sys.argv[1:] or ALL_QUERIES:
        start = time.time()
        try:
            wrong = compare(spark, duck, name, sf_dir)
        except Exception as error:  # noqa: BLE001
            wrong = "".join(traceback.format_exception_only(error))[:1500]
        print(f"{'FAIL' if wrong else 'ok':4} {name:36} {time.time() - start:6.2f}s {wrong or ''}", flush=True)
        if wrong:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")


if __name__ == "__main__":
    main()
