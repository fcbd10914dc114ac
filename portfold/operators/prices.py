"""Price history: selection, upkeep, and the join onto positions."""

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portfold.functions import text
from portfold.operators.asof import RANGE_DAYS, newest_before, spread_key
from portfold.operators.windows import latest_per_key
from portfold.schemas import CLASS_STOCK


def tracked_tickers(positions: DataFrame, asset_class: str = CLASS_STOCK) -> DataFrame:
    """The distinct non-empty assets of one class, as ``ticker``."""
    asset = F.col("asset")
    listed = positions.where((F.col("asset_class") == asset_class) & asset.isNotNull() & (asset != ""))
    return listed.select(asset.alias("ticker")).distinct()


def valid_closes(quotes: DataFrame) -> DataFrame:
    """Quotes with a positive close. NaN sorts above every number, so it has to be excluded by name."""
    close = F.col("close")
    return quotes.where((close > 0) & ~F.isnan(close))


def price_window(quotes: DataFrame, as_of: dt.date, lookback_days: int = 7) -> DataFrame:
    """Quotes of the ``lookback_days`` before ``as_of``, the day itself excluded."""
    first = as_of - dt.timedelta(days=lookback_days)
    return quotes.where((F.col("price_date") >= F.lit(first)) & (F.col("price_date") < F.lit(as_of)))


def prices_for(quotes: DataFrame, tickers: DataFrame) -> DataFrame:
    """Only the quotes of the given tickers."""
    return quotes.join(tickers, on="ticker", how="left_semi")


def quotes_for(quotes: DataFrame, tickers: DataFrame, suffix: str = ".SA") -> DataFrame:
    """Quotes listed under market symbols (``X.SA``), renamed back to the tickers they were asked for."""
    wanted = tickers.select("ticker", text.quote_symbol(F.col("ticker"), suffix).alias("symbol")).distinct()
    return quotes.withColumnRenamed("ticker", "symbol").join(wanted, on="symbol").select(
        "price_date", "ticker", "close", "fetched_at",
    )


def latest_closes(
    quotes: DataFrame, tiebreak: tuple[str, ...] = ("fetched_at", "close"), as_of: dt.date | None = None,
) -> DataFrame:
    """The newest valid close per ticker, in cents.

    ``as_of_date``, the day it prices positions of, is ``as_of``, or the day it was fetched if none is given.
    """
    newest = latest_per_key(valid_closes(quotes), ["ticker"], "price_date", tiebreak=tiebreak, once=True)
    day = F.lit(as_of) if as_of else F.col("fetched_at").cast("date")
    return newest.select("price_date", "ticker", F.round("close", 2).alias("close"), "fetched_at", day.alias("as_of_date"))


def merge_prices(history: DataFrame, batch: DataFrame) -> DataFrame:
    """History and batch in one table, one row per ticker and price date: the one fetched last."""
    return latest_per_key(
        history.unionByName(batch), ["ticker", "price_date"], "fetched_at", tiebreak=("close", "as_of_date"), once=True,
    )


def newest_prices(prices: DataFrame) -> DataFrame:
    """One price per ticker and as-of date: the one of the newest price date."""
    return latest_per_key(prices, ["ticker", "as_of_date"], "price_date", tiebreak=("fetched_at", "close"), once=True)


def _price_key(name: str) -> Column:
    """Day and name as one text; null if either is."""
    return F.concat(F.col("as_of_date").cast("string"), F.lit("|"), F.col(name))


def attach_price(positions: DataFrame, prices: DataFrame, *, mode: str = "latest") -> DataFrame:
    """Fill a missing ``current_price`` with the close for the position's asset and as-of date.

    ``mode="latest"`` takes one price per ticker and as-of date, so every position stays one row.
    ``mode="all"`` joins every price fetched on the as-of date: two price dates make two rows.

    A plain join: Spark broadcasts a small price side and splits hot keys. Positions that no price can change, without an
    asset or a date or, in ``latest`` mode, with a price of their own, get a key each that no price has, so they are not gathered
    under one empty key. Both sides are read once.
    """
    if mode not in ("latest", "all"):
        raise ValueError(f"mode is 'latest' or 'all', not {mode!r}")
    closes = newest_prices(prices) if mode == "latest" else prices
    # One text as the join key: the partitioning that the choice of newest prices left behind is then not reused, and Spark
    # shuffles both sides for the join, which is what lets it split a hot key.
    closes = closes.select(_price_key("ticker").alias("_priced"), F.col("close").alias("_close"))
    asks = _price_key("asset")
    if mode == "latest":
        asks = F.when(F.col("current_price").isNull(), asks)
    joined = positions.withColumn("_asks", spread_key(asks)).join(closes, F.col("_asks") == F.col("_priced"), "left")
    return joined.withColumn("current_price", F.coalesce("current_price", "_close")).select(*positions.columns)


def attach_price_asof(positions: DataFrame, prices: DataFrame, lookback_days: int = 7, *, range_days: int = RANGE_DAYS) -> DataFrame:
    """Fill a missing ``current_price`` with the newest valid close at or before the position's as-of date.

    Looks back ``lookback_days`` at most and goes by the price date, whenever the price was fetched; of several closes of a day the
    one fetched last counts. ``price_date`` says which day's close was taken, null where none was. Every position stays one row.

    Only the distinct assets and days that ask take part in the search; the answers come back by a plain join, whose hot keys
    Spark splits. ``positions`` is read twice.
    """
    asks = positions.where(F.col("current_price").isNull()).select(F.col("asset").alias("ticker"), "as_of_date")
    found = newest_before(
        asks, valid_closes(prices).select("ticker", "price_date", "close", "fetched_at"), "ticker", "as_of_date", "price_date", ("close",),
        lookback_days, tiebreak=("fetched_at",), range_days=range_days)
    found = found.select(_price_key("ticker").alias("_priced"), F.col("close").alias("_close"), F.col("price_date").alias("_price_date"))
    key = F.when(F.col("current_price").isNull(), _price_key("asset"))
    joined = positions.drop("price_date").withColumn("_asks", spread_key(key)).join(found, F.col("_asks") == F.col("_priced"), "left")
    return joined.withColumns({"current_price": F.coalesce("current_price", "_close"), "price_date": F.col("_price_date")}).select(
        *[c for c in positions.columns if c != "price_date"], "price_date")


def needed_days(positions: DataFrame, lookback_days: int = 7, asset_class: str = CLASS_STOCK) -> DataFrame:
    """``ticker`` and ``price_date``: the weekdays of the ``lookback_days`` before each day on which a tracked asset is held."""
    asset = F.col("asset")
    listed = positions.where((F.col("asset_class") == asset_class) & (asset != "") & F.col("as_of_date").isNotNull())
    held = listed.select(asset.alias("ticker"), "as_of_date").distinct()
    days = F.sequence(F.date_sub("as_of_date", lookback_days), F.date_sub("as_of_date", 1))
    return held.select("ticker", F.explode(days).alias("price_date")).where(F.weekday("price_date") < 5).distinct()


def missing_prices(
    positions: DataFrame, history: DataFrame, lookback_days: int = 7, asset_class: str = CLASS_STOCK, *, closed: DataFrame | None = None,
) -> DataFrame:
    """``ticker`` and ``price_date`` of the closes that positions need and ``history`` lacks: what is left to fetch.

    A day counts as there if the history has a valid close. ``closed`` (``price_date``) names days without trade. Before the
    anti-join both sides are one row per ticker and day, however many positions hold it.
    """
    needed = needed_days(positions, lookback_days, asset_class)
    if closed is not None:
        needed = needed.join(closed.select("price_date").distinct(), "price_date", "left_anti")
    have = valid_closes(history).select("ticker", "price_date").distinct()
    return needed.join(have, ["ticker", "price_date"], "left_anti").select("ticker", "price_date")


def fetch_plan(missing: DataFrame) -> DataFrame:
    """Missing days as requests: ``ticker``, ``first_day``, ``last_day`` and ``days``, one per unbroken run of weekdays."""
    day = F.col("price_date")
    # Weekdays are numbered through: Friday and the Monday after it follow each other. Day 4 after 1970-01-01 was a Monday.
    week = F.floor((F.unix_date(day) - 4) / 7)
    number = week * 5 + F.weekday(day)
    place = F.row_number().over(Window.partitionBy("ticker").orderBy("price_date"))
    return missing.withColumn("_run", number - place).groupBy("ticker", "_run").agg(
        F.min("price_date").alias("first_day"), F.max("price_date").alias("last_day"), F.count("*").alias("days"),
    ).drop("_run")
