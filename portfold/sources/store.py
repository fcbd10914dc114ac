"""The store: one folder per table, report tables partitioned by the month of their run.

    <root>/snapshot/v<time>/              full refresh, the newest complete version counts
    <root>/prices/                        months in versions, only the months a batch touches are rewritten
    <root>/state/                         partial sums by month, for runs that add months
    <root>/<report>/yyyymm=YYYYMM/        one run; other months stay untouched
"""

import re
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portfold.functions.dates import yyyymm
from portfold.operators.gates import Gate, GateError, check, observed
from portfold.operators.prices import merge_prices
from portfold.schemas import PRICES, REPORTS, SNAPSHOT
from portfold.sources import versions
from portfold.sources.scratch import materialize, scratch_folder

MONTH = "yyyymm"
PRICE_MONTH = "price_month"


def run_label(df: DataFrame, day: str = "as_of_date") -> DataFrame:
    """One row with the month of the newest date of the whole frame; null for an empty one."""
    return df.agg(yyyymm(F.max(day)).alias(MONTH))


def run_label_of(df: DataFrame, day: str = "as_of_date") -> str:
    """The run label as text. ``ValueError`` if the frame has no date to take it from."""
    label = run_label(df, day).first()[0]
    if label is None:
        raise ValueError(f"no run label: column {day} holds no date")
    return label


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop_path)


def _files(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right under ``path``, by metadata alone."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = _files(spark, path)
    if not files.exists(hadoop_path):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(hadoop_path) if f.isDirectory())


def _versions(spark: SparkSession, path: str) -> list[str]:
    """The complete versions of a table, oldest first. A version counts from the moment its success mark is there."""
    names = [name for name in _folders(spark, path) if name.startswith("v")]
    return [f"{path}/{name}" for name in names if _exists(spark, f"{path}/{name}/_SUCCESS")]


def full_path(spark: SparkSession, path: str) -> str:
    """Where the current version of a fully refreshed table is. ``FileNotFoundError`` if there is none."""
    versions = _versions(spark, path)
    if not versions:
        raise FileNotFoundError(f"no complete version of a table under {path}")
    return versions[-1]


def write_full(df: DataFrame, path: str, gates: Sequence[Gate] = ()) -> str:
    """Full refresh: write a new version of the table under ``path`` and return where it is.

    Nothing is renamed. The new version takes over when its success mark is put, the last step of the write, so a
    job that fails or dies at any point leaves the old version in force, and ``df`` may read from it. The version before stays
    for readers that still have it open; older ones, and what failed writes left behind, are deleted.

    ``gates`` are measured by the write itself. If one breaks, the new version gets no mark and is deleted, and ``GateError`` is raised.
    """
    spark = df.sparkSession
    before = _versions(spark, path)
    new = f"{path}/v{time.time_ns():020d}"
    rows, observation = observed(df, list(gates)) if gates else (df, None)
    rows.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", str(not gates).lower()).parquet(new)
    if observation:
        try:
            check(list(gates), observation.get)
        except GateError:
            _files(spark, new).delete(spark._jvm.org.apache.hadoop.fs.Path(new), True)
            raise
        _files(spark, new).create(spark._jvm.org.apache.hadoop.fs.Path(f"{new}/_SUCCESS")).close()
    if not _exists(spark, f"{new}/_SUCCESS"):
        raise OSError(f"{new} was written without a success mark")
    for name in _folders(spark, path):
        old = f"{path}/{name}"
        if old != new and old not in before[-1:] and not _files(spark, old).delete(spark._jvm.org.apache.hadoop.fs.Path(old), True):
            raise OSError(f"could not delete {old}")
    return new


def write_month(df: DataFrame, root: str, table: str | None, label: str) -> str:
    """Write one run of a report table, replacing that month of that table and nothing else.

    The old month goes only when the new one is committed.
    """
    if not table:
        raise ValueError("a report table needs a name")
    path = f"{root}/{table}"
    (
        df.withColumn(MONTH, F.lit(label))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    )
    return path


def read_table(spark: SparkSession, root: str, table: str, schema: T.StructType) -> DataFrame:
    """All months of a report table, the month as text. Empty when the table has not been written."""
    full = T.StructType([*schema.fields, T.StructField(MONTH, T.StringType())])
    path = f"{root}/{table}"
    return spark.read.schema(full).parquet(path) if _exists(spark, path) else spark.createDataFrame([], full)


def read_month(spark: SparkSession, root: str, table: str, schema: T.StructType, label: str) -> DataFrame:
    """One month of a report table; only that month's folder is read."""
    return read_table(spark, root, table, schema).where(F.col(MONTH) == label).drop(MONTH)


def list_months(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The six-digit months of a report table, newest first. Folders are listed, no file is opened."""
    found = [name.removeprefix(f"{MONTH}=") for name in _folders(spark, f"{root}/{table}") if name.startswith(f"{MONTH}=")]
    months = sorted((m for m in found if re.fullmatch("[0-9]{6}", m)), reverse=True)
    return spark.createDataFrame([(m,) for m in months], f"{MONTH} string")


def register_views(spark: SparkSession, root: str, month: str | None = None) -> list[str]:
    """Make the report tables, and the snapshot and the price history if they are stored, temporary views for SQL.

    Report tables show ``month`` only, or all months with a month column. Returns the names of the views.
    """
    views = {
        name: read_month(spark, root, name, schema, month) if month else read_table(spark, root, name, schema)
        for name, schema in REPORTS.items()
    }
    if _versions(spark, f"{root}/snapshot"):
        views["snapshot"] = spark.read.schema(SNAPSHOT).parquet(full_path(spark, f"{root}/snapshot"))
    if _exists(spark, f"{root}/prices"):
        views["prices"] = read_prices(spark, f"{root}/prices")
    for name, table in views.items():
        table.createOrReplaceTempView(name)
    return list(views)


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """The price history, empty if there is none yet: the version that is newest now, whatever is merged later."""
    return versions.read(spark, path, PRICES)


def upsert_prices(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """Merge a batch into the stored price history and return the new history.

    Only the price months found in the batch are read and written anew. The new months count from the commit of their manifest, so
    readers see the history before the merge or after it. Of two merges at once the later one builds on the earlier one.
    Merging the same batch twice changes nothing.
    """
    with scratch_folder(spark) as scratch:
        batch = materialize(batch.select(*PRICES.names), f"{scratch}/batch")
        label = versions.month_of(F.col("price_date"), yyyymm)
        # No more rows than the calendar has months.
        months = {row[0] for row in batch.select(label).distinct().collect()}
        if not months:
            return read_prices(spark, path)

        def merged(of: versions.Manifest) -> DataFrame:
            touched = versions.read(spark, path, PRICES, of, months)
            return merge_prices(touched, batch).withColumn(PRICE_MONTH, label)

        now = versions.update(spark, path, months, merged, PRICE_MONTH)
    return versions.read(spark, path, PRICES, now)
