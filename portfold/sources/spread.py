"""Parallelism for inputs that come in few pieces."""

from pyspark.sql import DataFrame

# Inputs in at least as many files are never dealt out: they have enough splits.
FEW_FILES = 64

# Rows of a task, where a table is dealt out by their number.
PIECE_ROWS = 500_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Have Spark deal the rows of an input in few files out by size (a rebalance, sized at run time).

    For files that Spark cannot split, such as CSV with line breaks inside values, or parquet with one row group:
    all narrow work that follows would be one task. ``keys`` should be those of the next join. An input in many
    files, as any large table is, is returned as it is and not shuffled.
    """
    return df.hint("rebalance", *keys) if len(df.inputFiles()) < FEW_FILES else df


def pieces_of(table: DataFrame) -> int:
    """Into how many partitions to deal the rows of a stored table, so that no task grows with it; 0 if the session's number will do.

    Parquet files name their number of rows, so none is read.
    """
    pieces = -(-table.count() // PIECE_ROWS)
    return pieces if pieces > int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) else 0
