"""Window operators. Orders end in a tie-break, so a result never depends on how rows arrive."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portfold.functions.numbers import exact, percent_over, ratio
from portfold.schemas import require_columns


def pct_change(
    df: DataFrame,
    keys: list[str],
    value: str = "market_value",
    period: str = "as_of_date",
    *,
    into: str = "pct_change",
    tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """Percent change of ``value`` against the previous row of the same ``keys`` by ``period``.

    Compares with the previous row that exists: a missing month is skipped, not counted as zero. Null on the
    first row and after a null or zero. Meant for aggregated input, where a key has one row per period, so a
    window partition is as long as the calendar however many rows the key had before.
    """
    order = Window.partitionBy(*keys).orderBy(period, *tiebreak)
    now = exact(df, value)
    compared = df.withColumn("_before", F.lag(now).over(order))
    return compared.withColumn(into, percent_over(now, F.col("_before"))).drop("_before")


def latest_per_key(
    df: DataFrame, keys: list[str], period: str = "as_of_date", *, tiebreak: tuple[str, ...] = (), once: bool = False,
) -> DataFrame:
    """The newest row of each key, ties decided by the largest ``tiebreak`` columns.

    ``once`` reads ``df`` a single time, for frames that cost something to derive: every task ranks its own rows, and only its best row
    of each key is shuffled and ranked again. Else ``df`` should be a stored table, and is read twice. First the newest period of each key is found by a hash aggregate over those columns alone, combined on the map side;
    then only rows of that period are ranked. The input is never sorted as a whole, and a key that holds much
    of it sends one row per task to the aggregate. Which join brings the two together is up to Spark.
    """
    order = [F.col(name).desc_nulls_last() for name in (period, *tiebreak)]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if once:
        return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")
    newest = df.groupBy(*keys).agg(F.max(period).alias(period)).select(*[F.col(c).alias(f"_{c}") for c in (*keys, period)])
    same = F.lit(True)
    for name in (*keys, period):
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return df.join(newest, same, "left_semi").withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def latest_per_key_sql(df: DataFrame, keys: list[str], period: str, tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """``latest_per_key`` written as a SQL statement over the frame.

    Only rows of a key's newest period are sorted. The frame is read twice, so no task sorts all of its rows.
    """
    newest = ", ".join(f"{name} DESC NULLS LAST" for name in (period, *tiebreak))
    same = " AND ".join(f"r.{name} <=> n.{name}" for name in (*keys, period))
    statement = f"""
        SELECT * EXCEPT (newest_first)
        FROM (
            SELECT *, row_number() OVER (PARTITION BY {", ".join(keys)} ORDER BY {newest}) AS newest_first
            FROM {{rows}} r LEFT SEMI JOIN (
                SELECT {", ".join(keys)}, max({period}) AS {period} FROM {{rows}} GROUP BY {", ".join(keys)}
            ) n ON {same}
        )
        WHERE newest_first = 1
    """
    return df.sparkSession.sql(statement, rows=df)


def share_of_total(
    df: DataFrame, scope: str, dim: str, value: str = "market_value", *, into: str = "share_pct", digits: int = 2,
) -> DataFrame:
    """Value per ``dim`` within ``scope`` and its percentage of the scope, as a pie chart shows it.

    Rows with the same label are added up first, so a window partition holds one row per label.
    """
    require_columns(df, [scope, dim, value], "pie chart")
    slices = df.groupBy(scope, dim).agg(F.sum(exact(df, value)).alias(value))
    compared = slices.withColumn("_whole", F.sum(value).over(Window.partitionBy(scope)))
    return compared.withColumn(into, ratio(F.col(value) * F.lit(100), F.col("_whole"), digits)).drop("_whole")


def last_points(
    df: DataFrame, series: str, period: str, label: Column, *, into: str = "label", tiebreak: tuple[str, ...] = (),
) -> DataFrame:
    """Put ``label`` on the last point of every series and empty text on the others.

    Of several points in the last period the one with the largest ``tiebreak`` columns is the last. Meant for aggregated input.
    """
    require_columns(df, [series, period], "line chart")
    newest = [F.col(name).desc_nulls_last() for name in (period, *tiebreak)]
    rank = F.row_number().over(Window.partitionBy(series).orderBy(*newest))
    return df.withColumn("_rank", rank).withColumn(into, F.when(F.col("_rank") == 1, label).otherwise(F.lit(""))).drop("_rank")


def since_year_start(
    df: DataFrame, keys: list[str], value: str = "market_value", day: str = "as_of_date", year: str = "year", *,
    base: str = "base_value", into: str = "ytd_pct",
) -> DataFrame:
    """Percent change of ``value`` since the year began: ``base``, what the year began with, and ``into``.

    A year begins with the last value of any year before; the first year of a key begins with its own first value. Meant for
    aggregated input with one row per key and day, where a window is as long as the calendar.
    """
    now = exact(df, value)
    by_year = Window.partitionBy(*keys).orderBy(year)
    before = F.max(F.struct(F.col(day).alias("day"), now.alias("value"))).over(by_year.rangeBetween(Window.unboundedPreceding, -1))
    first = F.first(now).over(Window.partitionBy(*keys, year).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    based = df.withColumn("_before", before).withColumn("_first", first)
    based = based.withColumn(base, F.when(F.col("_before").isNotNull(), F.col("_before.value")).otherwise(F.col("_first")))
    return based.withColumn(into, percent_over(now, F.col(base))).drop("_before", "_first")
