"""Read-side operators: what a dashboard asks of the report tables."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portfold.schemas import ALL, require_columns

# Fixed value: the head room of a chart axis, as a part of the value range.
AXIS_PADDING = 0.15

HOLDINGS = ["asset", "quantity", "avg_price", "current_price", "pct_change", "market_value"]


def scope_rows(df: DataFrame, institution: str, *, details_only: bool = False) -> DataFrame:
    """Rows of one institution, without its all-assets row if ``details_only``."""
    mine = df.where(F.col("institution") == institution)
    return mine.where(F.col("asset") != ALL) if details_only else mine


def holdings_table(labels: DataFrame, institution: str) -> DataFrame:
    """The holdings of an institution in the column order of the page."""
    require_columns(labels, ["institution", *HOLDINGS], "holdings table")
    return scope_rows(labels, institution, details_only=True).select(*HOLDINGS)


def exactly_one(df: DataFrame, value: str, what: str = "lookup") -> DataFrame:
    """The single ``value`` of a frame as one row. The query fails unless the frame has exactly one row."""
    rows = F.count(F.lit(1))
    problem = F.concat(F.lit(f"{what} needs exactly one row, found "), rows.cast("string"))
    return df.agg(F.when(rows == 1, F.max(value)).otherwise(F.raise_error(problem)).alias(value))


def headline_total(df: DataFrame, condition: Column, value: str = "market_value") -> float:
    """The value of the one row that meets ``condition``. ``ValueError`` for none or several."""
    found = df.where(condition).select(value).take(2)
    if len(found) != 1:
        raise ValueError("no row meets the condition" if not found else "several rows meet the condition")
    return found[0][0]


def _ends(value: str, percent: bool) -> list[Column]:
    low, high = F.min(value), F.max(value)
    pad = F.when(high == low, F.lit(1.0)).otherwise((high - low) * F.lit(AXIS_PADDING))
    first = low - pad if percent else F.when(high.isNotNull(), F.lit(0.0))
    return [first.alias("axis_low"), (high + pad).alias("axis_high")]


def axis_range(df: DataFrame, value: str, *, percent: bool = False) -> DataFrame:
    """``axis_low`` and ``axis_high`` of a chart. Amounts start at zero, percentages below their minimum."""
    require_columns(df, [value], "chart axis")
    return df.agg(*_ends(value, percent))


def axis_ranges(df: DataFrame, axes: dict[str, tuple[str, bool]]) -> DataFrame:
    """``axis_range`` of several columns in one pass: a row per ``kind``, which maps to the column and whether it is a percentage."""
    require_columns(df, [value for value, _ in axes.values()], "chart axes")
    rows = [F.struct(F.lit(kind).alias("kind"), *_ends(value, percent)) for kind, (value, percent) in axes.items()]
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def series_names(df: DataFrame, series: str) -> DataFrame:
    """The distinct names of the series of a chart."""
    return df.select(series).dropna().distinct()


def _resolved(chosen: str | None, column: str) -> Column:
    month = F.col(column)
    return F.coalesce(F.max(F.when(month == F.lit(chosen), month)), F.max(month)).alias(column)


def resolve_month(months: DataFrame, chosen: str | None, column: str = "yyyymm") -> DataFrame:
    """The chosen month if it is there, else the newest; null when there is none."""
    return months.agg(_resolved(chosen, column))


def resolve_months(months: DataFrame, asked: dict[str, str | None], column: str = "yyyymm") -> DataFrame:
    """``resolve_month`` for several choices in one pass: a row per key of ``asked``."""
    rows = [F.struct(F.lit(name).alias("asked"), _resolved(chosen, column)) for name, chosen in asked.items()]
    return months.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
