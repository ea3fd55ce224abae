"""Run registered queries in Spark and their SQL in DuckDB, and compare the rows as multisets."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"create view {name} as select * from '{path}'")
    return connection


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    values = frame.astype(object).where(frame.notna(), None)
    return sorted((tuple(row) for row in values.itertuples(index=False)), key=repr)


def differences(spark_frame: pd.DataFrame, sql_frame: pd.DataFrame) -> str | None:
    if sorted(spark_frame.columns) != sorted(sql_frame.columns):
        return f"columns {sorted(spark_frame.columns)} / {sorted(sql_frame.columns)}"
    for name in spark_frame.columns:
        if spark_frame[name].dtype == "float64" and sql_frame[name].dtype == "Int64":  # integers with nulls
            spark_frame = spark_frame.assign(**{name: spark_frame[name].astype("Int64")})
        if len(spark_frame) and spark_frame[name].dtype != sql_frame[name].dtype:
            return f"type of {name}: {spark_frame[name].dtype} / {sql_frame[name].dtype}"
    left, right = rows(spark_frame), rows(sql_frame)
    if len(left) != len(right):
        return f"{len(left)} / {len(right)} rows"
    for a, b in zip(left, right):
        if a != b:
            return f"{a} / {b}"
    return None


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf = sys.argv[1]
    only = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, sql = duck(sf), entry.oracle_sql()
    failed = 0
    for name, run in entry.queries().items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        try:
            found = run(spark, sf).toPandas()
            elapsed = time.perf_counter() - start
            result = "no sql" if name not in sql else differences(found, connection.sql(sql[name]).df()) or "ok"
        except Exception as error:  # report and go on
            found, elapsed = (), time.perf_counter() - start
            result = f"{type(error).__name__}: {str(error)[:600]}"
        failed += result not in ("ok", "no sql")
        print(f"{name:30} {len(found):7} rows {elapsed:6.2f} s  {result}", flush=True)
    print(f"{failed} failed")
    sys.exit(failed > 0)


if __name__ == "__main__":
    main()
