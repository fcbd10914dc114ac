"""CSV scans and exports. Columns are found by header, in any order, ours or the Portuguese one."""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portfold.operators.statements import conform
from portfold.schemas import CSV_HEADERS, FORM, SNAPSHOT, require_columns, with_csv_headers
from portfold.sources.scratch import materialize
from portfold.sources.spread import spread

# Answers of a file that is written: one task reads the whole file.
FORM_ROWS = 200_000

# Rows of a packed file: one task reads the whole file.
PACKED_ROWS = 500_000

_CORRUPT = "_corrupt_record"
_FITS = "fits"


def _named(read: DataFrame, schema: T.StructType, what: str) -> DataFrame:
    """The columns of ``schema`` under our names; ``ValueError`` if the file lacks one. Further columns are left out."""
    have = {name.strip().lower(): name for name in read.columns}
    found = {}
    for name in schema.names:
        header = next((h for h in (name, CSV_HEADERS.get(name, name)) if h in have), None)
        if header:
            found[name] = F.col(f"`{have[header]}`").cast("string").alias(name)
    require_columns(read.select(*found.values()) if found else read.select(), schema.names, what)
    return read.select(*[found[name] for name in schema.names])


def _scan(spark: SparkSession, path: str, line_ends: bool = True) -> DataFrame:
    """All columns as text; quotes inside a quoted value are doubled."""
    return spark.read.options(header=True, multiLine=line_ends, escape='"', inferSchema=False).csv(path)


def scan_form(spark: SparkSession, path: str) -> DataFrame:
    """Form answers as text, with statements that run over several lines inside quotes.

    A file with line breaks inside values cannot be split, so it is read by one task: deliver many files rather
    than a big one, and keep the snapshot in parquet. The rows of a few files are spread before they are parsed.
    """
    return spread(_named(_scan(spark, path), FORM, "form"))


class Checked(NamedTuple):
    """Rows of a scan that fit, under their columns, and the others: file, reason, and the record as it was read."""

    good: DataFrame
    bad: DataFrame


def scan_checked(spark: SparkSession, path: str, target: str, schema: T.StructType = FORM) -> Checked:
    """Scan CSV files once into ``target``: rows that fit the header, and beside them a quarantine of those that don't.

    ``ragged`` rows have more or fewer fields than the header has, among them rows whose quotes are open up to the end of the file. ``unclosed``
    rows have the right number, but their last field is open up to the end of the file and holds the rows that stood there: in a
    file with an odd number of quotes it is the last row, if its last field holds line ends. Their values are kept as JSON. So no
    line of a file is lost, and nothing half read gets in among the good rows.

    Rows are written once; the quotes are counted by a second, splittable scan of the files as text.
    """
    header = _scan(spark, path).columns
    fields = T.StructType([T.StructField(name, T.StringType()) for name in [*header, _CORRUPT]])
    read = spark.read.schema(fields).options(header=True, multiLine=True, escape='"', mode="PERMISSIVE", columnNameOfCorruptRecord=_CORRUPT)
    rows = read.csv(path).withColumns({"_file": F.col("_metadata.file_path"), "_place": F.monotonically_increasing_id()})
    rows = materialize(rows, f"{target}/read")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    odd = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), quotes.alias("quotes")).groupBy("_file").agg(
        F.sum("quotes").alias("quotes")).where("quotes % 2 = 1")
    # One row per file: its last one, which alone can be open.
    last = rows.groupBy("_file").agg(F.max("_place").alias("_place")).join(odd, "_file").select("_place", F.lit(True).alias("_open"))
    is_open = F.coalesce("_open", F.lit(False)) & F.col(f"`{header[-1]}`").contains("\n")
    reason = F.when(F.col(_CORRUPT).isNotNull(), "ragged").when(is_open, "unclosed").otherwise(_FITS)
    record = F.when(reason == "unclosed", F.to_json(F.struct(*[f"`{c}`" for c in header]))).otherwise(F.col(_CORRUPT))
    sorted_out = rows.join(last, "_place", "left").withColumns({"reason": reason, "record": record})
    sorted_out.drop("_open", "_place", _CORRUPT).write.partitionBy("reason").parquet(f"{target}/sorted")
    stored = spark.read.schema(T.StructType([*fields.fields[:-1], *T.StructType.fromDDL("_file string, record string, reason string").fields]))
    stored = stored.parquet(f"{target}/sorted")
    good = stored.where(F.col("reason") == _FITS).select(*[f"`{c}`" for c in header])
    bad = stored.where(F.col("reason") != _FITS).select(F.col("_file").alias("file"), "reason", "record")
    return Checked(_named(good, schema, "form"), bad)


def scan_table(spark: SparkSession, path: str, schema: T.StructType, *, line_ends: bool = True) -> DataFrame:
    """A typed CSV table; a value that does not fit its type becomes null, the row stays.

    ``line_ends`` says that values may hold line ends. Without them files are split, so that a large one is many tasks.
    """
    return conform(_named(_scan(spark, path, line_ends), schema, "table"), schema)


def scan_snapshot(spark: SparkSession, path: str, *, line_ends: bool = True) -> DataFrame:
    return scan_table(spark, path, SNAPSHOT, line_ends=line_ends)


def export_csv(df: DataFrame, path: str, *, portuguese: bool = False, packed: int = 0) -> None:
    """Write a table as CSV, on request under the Portuguese headers. Text keeps its outer spaces and line ends.

    With ``packed`` the files are gzipped, fast rather than closely, and hold so many rows at most: such files can't be split, so
    their number of rows, not the size of the table, bounds what a task reads. Scans unpack them by their ending.
    """
    rows = with_csv_headers(df) if portuguese else df
    packing = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": packed} if packed else {}
    rows.write.mode("overwrite").options(
        header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"',
        timestampFormat="yyyy-MM-dd HH:mm:ss", **packing,
    ).csv(path)


def export_form(answers: DataFrame, path: str, rows: int = FORM_ROWS) -> None:
    """Write form answers as CSV, whose statements hold line ends, in files of ``rows`` answers at most.

    Such files can't be split, so the number of answers in a file, not the size of the table, bounds what a task reads.
    """
    answers.write.options(header=True, quoteAll=True, escape='"', maxRecordsPerFile=rows).csv(path)
