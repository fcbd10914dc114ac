"""Compare registered queries with their SQL, value by value."""

import datetime as dt
import math
import sys
import tempfile
import time
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from __spark_entry__ import oracle_sql, queries  # noqa: E402


def spark_session() -> SparkSession:
    shared = tempfile.mkdtemp(prefix="portfold-tests-")
    spark = (
        SparkSession.builder.master("local[8]").appName("portfold-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", f"{shared}/scratch")
        .config("spark.sql.warehouse.dir", f"{shared}/warehouse")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"create view {path.stem} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, sf_dir: str) -> tuple[str, int]:
    """Empty text and the row count if query and SQL agree, else what differs."""
    frame = queries()[name](spark, sf_dir)
    got = rows_of(frame.columns, frame.collect())
    if name not in oracle_sql():
        return "", sum(got.values())
    cursor = con.execute(oracle_sql()[name])
    names = [column[0] for column in cursor.description]
    expected = rows_of(names, cursor.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} against {sorted(names)}", 0
    if got != expected:
        return (
            f"{sum(got.values())} rows against {sum(expected.values())};"
            f" only here {list((got - expected).items())[:3]}; only in SQL {list((expected - got).items())[:3]}"
        ), 0
    return "", sum(got.values())


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session, connection = spark_session(), duck(folder)
    chosen = sys.argv[2:] or list(queries())
    wrong = 0
    for key in chosen:
        start = time.time()
        try:
            problem, count = differences(session, connection, key, folder)
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem, count = f"{type(error).__name__}: {str(error)[:1500]}", 0
        wrong += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {key} rows={count} {time.time() - start:.2f}s {problem}", flush=True)
    print(f"{len(chosen) - wrong} of {len(chosen)} agree")
    sys.exit(bool(wrong))
