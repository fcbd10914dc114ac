"""From free-text statements to typed position lines. Narrow transformations only: no shuffle."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portfold.functions import dates, numbers, text
from portfold.schemas import MONEY

FIELDS = ("asset_class", "asset", "quantity", "avg_price", "current_price")


def explode_lines(df: DataFrame, cell: str = "statement", into: str = "line") -> DataFrame:
    """One row per line of ``cell``, whatever its line ends are. A blank line stays a row, a null cell gives none.

    Plain replacements and a one-character split: several times faster than one regular expression. A replacement compares at every
    character even where it finds nothing, so it is asked for only where there is a carriage return, which is a cheap search.
    """
    others = [name for name in df.columns if name != cell]

    def without(sign: str) -> Column:
        return F.when(F.contains(F.col(cell), F.lit("\r")), F.replace(F.col(cell), F.lit(sign), F.lit("\n"))).otherwise(F.col(cell))

    return df.withColumn(cell, without("\r\n")).select(*others, F.explode(F.split(without("\r"), "\n")).alias(into))


def parse_fields(df: DataFrame, line: str = "line", names: tuple[str, ...] = FIELDS, mark: str = "|") -> DataFrame:
    """Add the trimmed ``mark``-separated fields of ``line`` by position; fields a line lacks are null."""
    parts = F.split(line, re.escape(mark))
    return df.withColumns({name: F.trim(F.get(parts, F.lit(i))) for i, name in enumerate(names)})


def normalize_fields(df: DataFrame, names: tuple[str, ...] = FIELDS) -> DataFrame:
    """Apply the pt-BR numeral rule to every field, the text fields included."""
    return df.withColumns({name: text.decimal_from_ptbr(F.col(name)) for name in names})


def normalize_case(df: DataFrame) -> DataFrame:
    """Lower-case classes, upper-case institutions, and the class-dependent case of assets."""
    asset_class = F.lower("asset_class")
    return df.withColumns({
        "asset_class": asset_class,
        "institution": F.upper("institution"),
        "asset": text.asset_case(F.col("asset"), asset_class),
    })


def classify_exposure(df: DataFrame, abroad: tuple[str, ...] | None = None) -> DataFrame:
    """Add ``exposure``. Run it before ``normalize_case``: a listed asset typed in lower case counts as local."""
    asset = F.col("asset")
    return df.withColumn("exposure", text.exposure_of(asset, abroad) if abroad else text.exposure_of(asset))


def calendar_columns(df: DataFrame, day: str = "as_of_date") -> DataFrame:
    """Add ``year``, ``month_num`` and ``month_label`` of a date column."""
    return df.withColumns({
        "year": F.year(day),
        "month_num": F.month(day),
        "month_label": dates.month_label(F.col(day)),
    })


def _lenient(name: str, kind: T.DataType, source: T.DataType) -> Column:
    value = F.col(name)
    if not isinstance(source, T.StringType) or isinstance(kind, T.StringType):
        return value.try_cast(kind)
    if isinstance(kind, T.DecimalType):
        return F.when(numbers.to_number(value).isNotNull(), numbers.castable(value).try_cast(kind))
    if isinstance(kind, T.IntegerType):
        # "2026.0" is a whole number too: tools that know no null integers write it that way.
        return numbers.to_number(value).try_cast(kind)
    if isinstance(kind, T.DoubleType):
        return numbers.to_number(value)
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return numbers.castable(value).try_cast(kind)
    return numbers.bare(value).try_cast(kind)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to ``schema`` in its order and types; values that do not fit their type become null."""
    have = {field.name: field.dataType for field in df.schema.fields}
    return df.select(*[
        _lenient(field.name, field.dataType, have[field.name]).alias(field.name) for field in schema.fields
    ])


def value_positions(df: DataFrame) -> DataFrame:
    """Add ``market_value``, the product of current price and quantity in cents."""
    return df.withColumn("market_value", numbers.product(F.col("current_price"), F.col("quantity"), 2, MONEY))
