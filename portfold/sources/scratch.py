"""Intermediate tables that cut lineage."""

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder: ``spark.checkpoint.dir``, or ``scratch`` in the warehouse if that is unset.

    Every executor must reach that folder. Whoever asks for the path deletes what is written there; tables that
    a returned frame reads from stay until the owner of the folder clears it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{shared.rstrip('/')}/portfold-{uuid.uuid4().hex}/{name}"


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """A new scratch folder that is gone afterwards. Frames that read from it must be used up by then."""
    folder = scratch_path(spark, "run")
    try:
        yield folder
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` once and return the written table, for frames that several tables are built from."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Spark deletes the shuffle files of a write when it ends; else they stay until the driver happens to collect its garbage.
_FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, path: str) -> DataFrame:
    """Like ``materialize``, for a frame with large shuffles: their files are gone afterwards, and the table is packed closer.

    So what follows needs the disk of the table alone. The setting that this takes is put back.
    """
    conf = df.sparkSession.conf
    before = conf.get(_FREE_SHUFFLES, None)
    conf.set(_FREE_SHUFFLES, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if before is None:
            conf.unset(_FREE_SHUFFLES)
        else:
            conf.set(_FREE_SHUFFLES, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)
