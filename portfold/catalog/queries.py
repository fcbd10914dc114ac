"""The registered queries. Each takes a session and a folder of test tables and returns a DataFrame.

Money leaves a query as double; inside it is decimal.
"""

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portfold import schemas
from portfold.catalog import inputs
from portfold.functions import dates, numbers, sql, text
from portfold.operators import contributions, gates, prices, statements, totals, views, windows
from portfold.plans import pages, reports, runs
from portfold.plans.snapshot import position_lines, price_lines
from portfold.sources import csv_files, store, versions
from portfold.sources.scratch import materialize, scratch_folder, scratch_path

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}

# Parameters that the SQL of the oracle repeats.
AS_OF = dt.date(2024, 1, 15)
TRACKED_CLASS = "PROMO"
INSTITUTION = "BUILDING"
MONTH = "199803"
SPLIT_DAY = dt.date(1998, 1, 1)
DAY = reports.DAY
CURRENT_KEYS = ["as_of_date", "institution", "asset"]


def query(build: Query) -> Query:
    """Register a query under its function name."""
    QUERIES[build.__name__] = build
    return build


def doubles(df: DataFrame) -> DataFrame:
    """Decimal columns as double."""
    decimals = [field.name for field in df.schema.fields if isinstance(field.dataType, T.DecimalType)]
    return df.withColumns({name: F.col(name).cast("double") for name in decimals})


# --- sources and sinks ---------------------------------------------------------------------------------


@query
def scan_bronze_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the form answers as multi-line CSV, with the columns in another order and one more, scan them, and split the cells."""
    path = scratch_path(spark, "form")
    answers = schemas.with_csv_headers(inputs.form(spark, sf_dir).withColumn("extra", F.lit("not asked for")))
    csv_files.export_form(answers.select(*reversed(answers.columns)), path)
    return statements.explode_lines(csv_files.scan_form(spark, path))


@query
def scan_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write typed position lines as CSV and scan them back."""
    path = scratch_path(spark, "snapshot")
    with scratch_folder(spark) as folder:
        lines = statements.value_positions(position_lines(inputs.form(spark, sf_dir, joined=f"{folder}/joined")))
        csv_files.export_csv(lines.select(*schemas.SNAPSHOT.names), path, portuguese=True, packed=csv_files.PACKED_ROWS)
    scanned = csv_files.scan_snapshot(spark, path, line_ends=False)
    return doubles(scanned).withColumn("submitted_at", F.col("submitted_at").cast("timestamp_ntz"))


@query
def scan_snapshot_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same way there and back for names with quotes, commas, backslashes and line ends."""
    path = scratch_path(spark, "snapshot")
    odd = F.concat(F.col("p_name"), F.lit(' say "hi", ok \\ or "no"\nsecond, line'), F.col("p_size").cast("string"))
    parts = inputs.table(spark, sf_dir, "part").select(odd.alias("asset"), F.col("p_brand").alias("institution"), "p_size")
    named = statements.conform(parts.withColumns({
        name: F.col("p_size").cast("double") if name == "quantity" else F.lit(None).cast("string")
        for name in schemas.SNAPSHOT.names if name not in parts.columns
    }), schemas.SNAPSHOT)
    csv_files.export_csv(named, path)
    return csv_files.scan_snapshot(spark, path).select("institution", "asset", "quantity")


@query
def scan_form_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damaged form files scanned once: the statements that fit, and the records that don't, with the reason."""
    path = scratch_path(spark, "form")
    inputs.damaged_form(spark, sf_dir, path)
    checked = csv_files.scan_checked(spark, path, scratch_path(spark, "checked"))
    good = checked.good.select(F.lit("fits").alias("reason"), F.concat_ws("#", *schemas.FORM.names).alias("record"))
    return good.unionByName(checked.bad.select("reason", "record"))


def _monthly_store(spark: SparkSession, sf_dir: str) -> str:
    """A store whose home_line table has one partition per month of data."""
    root = scratch_path(spark, "store")
    rows = reports.home_line(inputs.positions(spark, sf_dir))
    months = rows.withColumn(store.MONTH, dates.yyyymm(F.col("as_of_date")))
    months.hint("rebalance", store.MONTH).write.partitionBy(store.MONTH).parquet(f"{root}/home_line")
    return root


@query
def list_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.list_months(spark, _monthly_store(spark, sf_dir), "home_line")


@query
def read_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _monthly_store(spark, sf_dir)
    return store.read_month(spark, root, "home_line", schemas.HOME_LINE, MONTH)


@query
def resolve_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month that is there, one that is not, and none."""
    days = inputs.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day"))
    months = days.select(dates.yyyymm(F.col("day")).alias("yyyymm")).distinct()
    return views.resolve_months(months, {MONTH: MONTH, "190001": "190001", "none": None})


@query
def price_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    quotes = prices.price_window(inputs.ticks(spark, sf_dir), AS_OF)
    return quotes.select("event_id", "ticker", "price_date", "close")


@query
def sql_latest_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lots = inputs.positions(spark, sf_dir)
    latest = windows.latest_per_key_sql(
        lots, ["institution", "asset_class", "asset"], "as_of_date", inputs.LOT_ORDER,
    )
    return _lots(latest)


@query
def sink_full_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the raw positions, then replace them by their totals, built from what is being replaced."""
    path = scratch_path(spark, "snapshot")
    lots = inputs.positions(spark, sf_dir).select("as_of_date", "institution", "market_value")
    stored = spark.read.schema(lots.schema).parquet(store.write_full(lots, path))
    reduced = totals.total_by(stored, ["as_of_date", "institution"])
    return doubles(spark.read.schema(reduced.schema).parquet(store.write_full(reduced, path)))


@query
def gated_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish the positions up to a day through gates, then try all of them, whose value has grown too much: the first stay.

    One row per attempt: whether it was published, and what the gates measured; and the rows that are in force at the end.
    """
    path = scratch_path(spark, "snapshot")
    lots = inputs.positions(spark, sf_dir).select("as_of_date", "institution", "market_value")
    checks = gates.snapshot_gates(least_rows=10, newest=SPLIT_DAY - dt.timedelta(days=31), unpriced=0.0)
    store.write_full(lots.where(F.col("as_of_date") < F.lit(SPLIT_DAY)), path, checks)
    first = spark.read.schema(lots.schema).parquet(store.full_path(spark, path))
    worth = first.agg(F.sum("market_value")).first()[0]
    bound = gates.Gate("worth", F.sum("market_value"), greatest=worth)
    attempts = []
    for name, rows in (("same", first), ("grown", lots)):
        try:
            store.write_full(rows, path, [*checks, bound])
            attempts.append((name, True))
        except gates.GateError:
            attempts.append((name, False))
    current = spark.read.schema(lots.schema).parquet(store.full_path(spark, path))
    held = current.agg(F.count(F.lit(1)).alias("rows"), F.max("as_of_date").alias("newest"), F.sum("market_value").cast("double").alias("worth"))
    each = [held.select(F.lit(name).alias("attempt"), F.lit(published).alias("published"), "*") for name, published in attempts]
    return each[0].unionByName(each[1])


@query
def sink_month_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write two runs of a table, write the first again with other values, and read both."""
    root = scratch_path(spark, "store")
    rows = materialize(reports.home_line(inputs.positions(spark, sf_dir)), scratch_path(spark, "home_line"))
    early = rows.where(F.col("as_of_date") < F.lit(SPLIT_DAY))
    late = rows.where(F.col("as_of_date") >= F.lit(SPLIT_DAY))
    early_label = store.run_label_of(early)
    store.write_month(early, root, "home_line", early_label)
    store.write_month(late, root, "home_line", store.run_label_of(late))
    doubled = early.withColumn("market_value", F.col("market_value") * 2)
    store.write_month(doubled, root, "home_line", early_label)
    return store.read_table(spark, root, "home_line", schemas.HOME_LINE)


@query
def run_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.run_label(inputs.positions(spark, sf_dir))


# --- projections and scalar functions ------------------------------------------------------------------


@query
def explode_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statements.explode_lines(inputs.doc_lines(spark, sf_dir), "text", "line")


@query
def parse_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trimmed fields of every statement line, numbers as numbers although tabs stand around them."""
    lines = statements.explode_lines(inputs.form(spark, sf_dir, around="\t").select("as_of_date", "institution", "statement"))
    fields = statements.normalize_fields(statements.parse_fields(lines))
    numeric = ("quantity", "avg_price", "current_price")
    return fields.withColumns({name: numbers.to_number(F.col(name)) for name in numeric}).drop("line")


@query
def normalize_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numeral rule over free text: every line of every document."""
    lines = statements.explode_lines(inputs.doc_lines(spark, sf_dir), "text", "line")
    return lines.select("doc_id", text.decimal_from_ptbr(F.col("line")).alias("plain"))


@query
def lenient_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers out of text that mostly holds none: document words, order keys, prices and dates as text."""
    words = inputs.table(spark, sf_dir, "documents").select(
        F.lit("document").alias("source"), F.explode(F.split("text", "[ \n|]")).alias("word"),
    )
    lines = inputs.table(spark, sf_dir, "lineitem")
    typed = [
        lines.select(F.lit(name).alias("source"), F.concat(F.lit("\t"), F.col(name).cast("string"), F.lit(" \t")).alias("word"))
        for name in ("l_orderkey", "l_extendedprice", "l_returnflag")
    ]
    texts = words.unionByName(typed[0]).unionByName(typed[1]).unionByName(typed[2])
    number = numbers.to_number(F.col("word"))
    return texts.groupBy("source").agg(
        F.count(F.lit(1)).alias("words"),
        F.count(number).alias("numbers"),
        F.min(number).alias("smallest"),
        F.max(number).alias("largest"),
    )


@query
def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form dates and times, every tenth of them in a form that the pattern does not allow."""
    order, moment = F.col("o_orderkey"), F.col("o_orderdate")
    typed = F.when(order % 10 == 0, F.date_format(moment, "yyyy-MM-dd")).otherwise(
        F.date_format(moment, "dd/MM/yyyy HH:mm:ss"),
    )
    return inputs.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        dates.to_day(F.substring(typed, 1, 10), dates.FORM_DATE).alias("form_day"),
        dates.to_moment(typed, dates.FORM_TIMESTAMP).cast("timestamp_ntz").alias("form_moment"),
        dates.to_day(typed).alias("iso_day"),
    )


@query
def calendar_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = inputs.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("date").alias("as_of_date"),
    )
    return statements.calendar_columns(orders)


@query
def conform_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text table projected to a typed one; one column holds letters where a number is due."""
    lines = inputs.table(spark, sf_dir, "lineitem")
    as_text = lines.select(*[F.col(name).cast("string").alias(name) for name in lines.columns])
    contract = T.StructType([
        T.StructField("l_shipdate", T.DateType()),
        T.StructField("l_orderkey", T.LongType()),
        T.StructField("l_linenumber", T.IntegerType()),
        T.StructField("l_returnflag", T.DoubleType()),
        T.StructField("l_linestatus", T.StringType()),
        T.StructField("l_quantity", T.IntegerType()),
        T.StructField("l_extendedprice", T.DoubleType()),
    ])
    return statements.conform(as_text, contract)


@query
def normalize_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = inputs.order_lines(spark, sf_dir).select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "A", "Stock").otherwise(F.col("p_type")).alias("asset_class"),
        F.initcap("c_mktsegment").alias("institution"),
        F.col("p_brand").alias("asset"),
    )
    return statements.normalize_case(named)


@query
def classify_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = inputs.table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("asset"))
    return statements.classify_exposure(parts, inputs.BRANDS_ABROAD)


@query
def symbol_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as tickers, some of them with a market of their own."""
    brand = F.col("p_brand")
    ticker = F.when(F.col("p_size") % 5 == 0, F.concat(brand, F.lit(".US"))).otherwise(brand)
    tickers = inputs.table(spark, sf_dir, "part").select("p_partkey", ticker.alias("ticker"))
    return tickers.withColumn("symbol", text.quote_symbol(F.col("ticker")))


@query
def market_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("current_price"),
        (F.lit(1.0) - F.col("l_discount")).alias("quantity"),
    )
    return doubles(statements.value_positions(lines))


def _many_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with prices of twelve decimals and quantities up to 10^12."""
    decimals = F.lpad((F.col("l_orderkey") * 7919 % 10**12).cast("string"), 12, "0")
    return inputs.table(spark, sf_dir, "lineitem").select(
        "*", F.concat(F.lit("0."), decimals).cast("double").alias("price"),
        (F.col("l_quantity") * 1e10 + F.col("l_linenumber")).alias("units"),
    )


@query
def market_value_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of tiny prices and huge quantities, to the cent; lines that are too big to be true have none."""
    too_big = F.col("l_orderkey") % 1009 == 0
    lines = _many_digits(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", F.when(too_big, 1e30).otherwise(F.col("price")).alias("current_price"),
        F.col("units").alias("quantity"),
    )
    return doubles(statements.value_positions(lines))


@query
def format_brl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The amount as number and as text with a decimal comma, alone and behind a title."""
    price = F.col("o_totalprice")
    with_comma = F.replace(price.cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(","))
    return inputs.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        text.brl(price).alias("from_number"),
        text.brl(with_comma).alias("from_text"),
        text.titled_brl(F.col("o_orderpriority"), price).alias("titled"),
    )


@query
def format_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = reports.home_line(inputs.positions(spark, sf_dir))
    return line.select(
        "as_of_date", "institution",
        text.amount_label(F.col("market_value")).alias("amount"),
        text.percent_label(F.col("pct_change")).alias("percent"),
    )


@query
def format_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = dates.yyyymm(F.col("o_orderdate").cast("date"))
    orders = inputs.table(spark, sf_dir, "orders").select("o_orderkey", month.alias("yyyymm"))
    return orders.withColumn("title", text.month_title(F.col("yyyymm")))


# --- totals --------------------------------------------------------------------------------------------


@query
def total_by_institution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(totals.total_by(inputs.positions(spark, sf_dir), [*DAY, "institution"]))


@query
def total_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = totals.total_by(inputs.positions(spark, sf_dir), DAY)
    return doubles(whole.withColumn("institution", F.lit(schemas.ALL)))


@query
def scoped_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(totals.scoped_totals(
        inputs.positions(spark, sf_dir), DAY, "institution",
        detail_scope=schemas.SCOPE_INSTITUTION, total_scope=schemas.SCOPE_HOME,
    ))


@query
def scoped_totals_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(totals.scoped_totals_by_union(inputs.positions(spark, sf_dir), DAY, "institution"))


@query
def total_by_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(totals.total_by(inputs.positions(spark, sf_dir), [*DAY, "institution", "asset"]))


@query
def asset_scoped_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(totals.scoped_totals(inputs.positions(spark, sf_dir), [*DAY, "institution"], "asset"))


@query
def annual_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = totals.scoped_totals(inputs.positions(spark, sf_dir), DAY, "institution")
    return doubles(totals.total_by(scoped, ["as_of_date", "year", "institution"]))


@query
def annual_totals_by_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = totals.scoped_totals(inputs.positions(spark, sf_dir), [*DAY, "institution"], "asset")
    return doubles(totals.total_by(scoped, ["as_of_date", "year", "institution", "asset"]))


def _current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.current_positions(inputs.positions(spark, sf_dir), inputs.LOT_ORDER)


@query
def allocation_by_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(totals.allocation(_current(spark, sf_dir), "exposure"))


@query
def allocation_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(totals.allocation(_current(spark, sf_dir), "asset_class"))


@query
def cost_basis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all lots, so that every group has several prices to weigh."""
    return doubles(totals.cost_basis(inputs.positions(spark, sf_dir), CURRENT_KEYS))


@query
def cost_basis_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of prices with twelve decimals and quantities up to 10^12."""
    lots = _many_digits(spark, sf_dir).select(
        "l_returnflag", "l_linestatus", F.col("price").alias("avg_price"), F.col("units").alias("quantity"),
        F.col("l_extendedprice").cast(schemas.MONEY).alias("market_value"),
    )
    return doubles(totals.cost_basis(lots, ["l_returnflag", "l_linestatus"]))


@query
def asset_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest totals joined with the cost basis of all lots of that date."""
    lots = inputs.positions(spark, sf_dir)
    line = windows.pct_change(totals.scoped_totals(lots, [*DAY, "institution"], "asset"), ["institution", "asset"])
    latest = windows.latest_per_key(line, ["institution", "asset"])
    return doubles(totals.label_positions(latest, totals.cost_basis(lots, CURRENT_KEYS), CURRENT_KEYS))


# --- windows -------------------------------------------------------------------------------------------


@query
def pct_change_institution(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = totals.scoped_totals(inputs.positions(spark, sf_dir), ["as_of_date"], "institution")
    return doubles(windows.pct_change(scoped, ["institution"]))


@query
def pct_change_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = totals.scoped_totals(inputs.positions(spark, sf_dir), ["as_of_date", "institution"], "asset")
    return doubles(windows.pct_change(scoped, ["institution", "asset"]))


@query
def pct_change_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One value per year, that of its last date: what the annual table holds with one snapshot a year."""
    line = totals.scoped_totals(inputs.positions(spark, sf_dir), ["as_of_date", "year"], "institution")
    yearly = totals.total_by(windows.latest_per_key(line, ["institution", "year"]), ["as_of_date", "year", "institution"])
    return doubles(windows.pct_change(yearly, ["institution"]))


@query
def pct_change_annual_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = totals.scoped_totals(inputs.positions(spark, sf_dir), ["as_of_date", "year", "institution"], "asset")
    keys = ["as_of_date", "year", "institution", "asset"]
    yearly = totals.total_by(windows.latest_per_key(line, ["institution", "asset", "year"]), keys)
    return doubles(windows.pct_change(yearly, ["institution", "asset"]))


@query
def latest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = totals.scoped_totals(inputs.positions(spark, sf_dir), DAY, "institution")
    return doubles(windows.latest_per_key(scoped, ["institution"]))


@query
def latest_asset_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    scoped = totals.scoped_totals(inputs.positions(spark, sf_dir), [*DAY, "institution"], "asset")
    return doubles(windows.latest_per_key(scoped, ["institution", "asset"]))


def _lots(df: DataFrame) -> DataFrame:
    return doubles(df.select(
        "as_of_date", "institution", "asset_class", "asset", "exposure", "quantity", "avg_price", "market_value",
        "l_orderkey", "l_linenumber",
    ))


@query
def current_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lots(_current(spark, sf_dir))


@query
def latest_valid_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.latest_closes(inputs.ticks(spark, sf_dir), tiebreak=("fetched_at", "event_id"))


@query
def series_last_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = reports.home_line(inputs.positions(spark, sf_dir))
    labelled = windows.last_points(line, "institution", "as_of_date", text.amount_label(F.col("market_value")))
    return labelled.select("institution", "as_of_date", "market_value", "label")


@query
def allocation_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = totals.allocation(_current(spark, sf_dir), "asset_class")
    return doubles(windows.share_of_total(slices, "institution", "asset_class"))


# --- prices --------------------------------------------------------------------------------------------


@query
def valid_closes(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = prices.valid_closes(inputs.ticks(spark, sf_dir))
    return valid.select("event_id", "ticker", "price_date", "close")


@query
def tracked_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.tracked_tickers(inputs.positions(spark, sf_dir), TRACKED_CLASS)


@query
def prices_for_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    owned = inputs.holdings(spark, sf_dir).select(F.col("asset").alias("ticker")).distinct()
    kept = prices.prices_for(inputs.ticks(spark, sf_dir), owned)
    return kept.select("event_id", "ticker", "price_date", "close")


@query
def attach_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.attach_price(inputs.holdings(spark, sf_dir), inputs.view_prices(spark, sf_dir))


@query
def attach_price_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.attach_price(inputs.holdings(spark, sf_dir), inputs.view_prices(spark, sf_dir), mode="all")


@query
def attach_price_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a position, and every event with a valid close as a price."""
    events = inputs.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("holding_id"),
        F.when(F.col("event_type") != "login", F.concat(F.lit("T"), F.col("user_id").cast("string"))).alias("asset"),
        F.col("ts").cast("date").alias("as_of_date"), F.col("value").alias("quantity"),
        F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("current_price"),
    )
    return prices.attach_price(events, prices.valid_closes(inputs.ticks(spark, sf_dir)))


@query
def attach_price_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a position, priced by the newest view of the three days before it and its own day."""
    return prices.attach_price_asof(inputs.event_positions(spark, sf_dir), inputs.view_prices(spark, sf_dir), lookback_days=3)


@query
def missing_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The closes that the events held as stock need and the views lack."""
    return prices.missing_prices(inputs.event_positions(spark, sf_dir), inputs.view_prices(spark, sf_dir))


@query
def price_fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.fetch_plan(missing_prices(spark, sf_dir))


def _valid_ticks(spark: SparkSession, sf_dir: str, *, views_only: bool) -> DataFrame:
    valid = prices.valid_closes(inputs.ticks(spark, sf_dir))
    is_view = F.col("event_type") == "view"
    return valid.where(is_view if views_only else ~is_view).select(*schemas.PRICES.names)


@query
def merge_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of valid closes, the view events and the others, merged."""
    history = _valid_ticks(spark, sf_dir, views_only=True)
    return prices.merge_prices(history, _valid_ticks(spark, sf_dir, views_only=False))


@query
def price_history_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same merge through the stored price history, the second batch twice."""
    path = scratch_path(spark, "prices")
    store.upsert_prices(spark, path, _as_stored(_valid_ticks(spark, sf_dir, views_only=True)))
    batch = _as_stored(_valid_ticks(spark, sf_dir, views_only=False))
    store.upsert_prices(spark, path, batch)
    history = store.upsert_prices(spark, path, batch)
    return history.withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))


@query
def price_history_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of the first version and one of the second find, after both were merged."""
    path = scratch_path(spark, "prices")
    for views_only in (True, False):
        store.upsert_prices(spark, path, _as_stored(_valid_ticks(spark, sf_dir, views_only=views_only)))
    found = [versions.read(spark, path, schemas.PRICES, versions.manifest(spark, path, n)).withColumn("version", F.lit(n)) for n in (1, 2)]
    both = found[0].unionByName(found[1])
    return both.withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))


def _as_stored(quotes: DataFrame) -> DataFrame:
    return quotes.withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))


@query
def price_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run of price upkeep: window, tracked tickers under their market symbols, latest valid close, merge."""
    owned = inputs.holdings(spark, sf_dir).withColumn("asset_class", F.lit(schemas.CLASS_STOCK))
    quoted = _as_stored(inputs.ticks(spark, sf_dir)).withColumn("ticker", text.quote_symbol(F.col("ticker")))
    history = runs.refresh_prices(spark, scratch_path(spark, "prices"), quoted, owned, AS_OF)
    return history.withColumn("fetched_at", F.col("fetched_at").cast("timestamp_ntz"))


# --- report tables -------------------------------------------------------------------------------------


@query
def mart_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form answers to snapshot, missing prices filled from a history merged from older and newer quotes."""
    quotes = prices.valid_closes(inputs.stock_quotes(spark, sf_dir))
    older = quotes.where(F.col("as_of_date") < F.lit(SPLIT_DAY))
    newer = quotes.where(F.col("as_of_date") >= F.lit(SPLIT_DAY))
    # Stored, as a history is: its size is known when the join is planned, so the lines are not shuffled to meet a few prices.
    history = materialize(prices.merge_prices(older, newer), scratch_path(spark, "history"))
    snapshot = price_lines(position_lines(inputs.form(spark, sf_dir)), history)
    return doubles(snapshot).withColumn("submitted_at", F.col("submitted_at").cast("timestamp_ntz"))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.daily_totals(inputs.positions(spark, sf_dir))


@query
def mart_home_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.home_line(inputs.positions(spark, sf_dir))


@query
def mart_home_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.home_latest(mart_home_line(spark, sf_dir))


@query
def mart_home_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.home_annual(mart_home_line(spark, sf_dir))


@query
def mart_alloc_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.alloc_exposure(_current(spark, sf_dir))


@query
def mart_alloc_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.alloc_class(_current(spark, sf_dir))


@query
def mart_asset_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.asset_line(_daily(spark, sf_dir))


@query
def mart_asset_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.asset_label(mart_asset_line(spark, sf_dir), _current(spark, sf_dir))


@query
def mart_asset_annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.asset_annual(mart_asset_line(spark, sf_dir))


@query
def mart_home_ytd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A third of the months is left out, so years begin and end with gaps."""
    line = reports.home_line(inputs.positions(spark, sf_dir).where(F.col("month_num") % 3 != 1))
    return doubles(reports.home_ytd(line))


@query
def incremental_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months added in three runs, the last of them delivering a month in the middle again: lines, allocation and labels."""
    lots = materialize(inputs.positions(spark, sf_dir), scratch_path(spark, "lots"))
    root, day = scratch_path(spark, "store"), F.col("as_of_date")
    again = day == F.lit(SPLIT_DAY)
    wrong = lots.where(again).withColumn("market_value", (F.col("market_value") * 2).cast(inputs.MONEY))
    for part in (lots.where(day < F.lit(SPLIT_DAY)).unionByName(wrong), lots.where(day > F.lit(SPLIT_DAY)), lots.where(again)):
        runs.add_months(spark, part, root, inputs.LOT_ORDER)
    month = store.list_months(spark, root, "home_line").first()[0]
    stored = {name: store.read_month(spark, root, name, schemas.REPORTS[name], month) for name in ("home_line", "alloc_class", "asset_label")}
    shape = ("as_of_date", "institution", "name", "market_value", "detail")
    parts = [
        stored["home_line"].select("as_of_date", "institution", F.col("scope").alias("name"), "market_value", F.col("pct_change").alias("detail")),
        stored["alloc_class"].select("as_of_date", "institution", F.col("asset_class").alias("name"), "market_value", F.lit(None).cast("double").alias("detail")),
        stored["asset_label"].select("as_of_date", "institution", F.col("asset").alias("name"), "market_value", F.col("entry_cost").alias("detail")),
    ]
    return parts[0].select(*shape).union(parts[1].select(*shape)).union(parts[2].select(*shape))


# --- contributions -------------------------------------------------------------------------------------

PAID_BY = ("l_orderkey",)


@query
def contributions_by_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(contributions.contributions_by(inputs.paid_positions(spark, sf_dir), answer=PAID_BY, dealt=True))


@query
def time_weighted_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doubles(contributions.time_weighted_return(inputs.paid_positions(spark, sf_dir), answer=PAID_BY))


# --- pages ---------------------------------------------------------------------------------------------


def _stored(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """A whole report run in a fresh store: its root and month."""
    root = scratch_path(spark, "store")
    lots = materialize(inputs.positions(spark, sf_dir), scratch_path(spark, "lots"))
    runs.run_reports(spark, lots, root, inputs.LOT_ORDER)
    return root, store.list_months(spark, root, "home_line").first()[0]


def _stored_month(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return pages.load_month(spark, *_stored(spark, sf_dir))


@query
def sql_stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored tables joined in SQL by name: the classes that an institution holds on its newest date."""
    store.register_views(spark, *_stored(spark, sf_dir))
    return spark.sql("""
        SELECT h.institution, h.as_of_date, h.market_value, a.asset_class, a.market_value AS class_value
        FROM home_latest h JOIN alloc_class a ON h.institution = a.institution AND h.as_of_date = a.as_of_date
    """)


@query
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements parsed, priced and formatted in SQL alone, with prices from a stored table: one per ticker and day."""
    sql.register(spark)
    quotes = prices.newest_prices(prices.valid_closes(inputs.stock_quotes(spark, sf_dir)))
    quotes = materialize(quotes, scratch_path(spark, "quotes"))
    return spark.sql("""
        WITH lines AS (
            SELECT to_date(as_of_date, 'dd/MM/yyyy') AS as_of_date, institution,
                   explode(split(replace(replace(statement, '\\r\\n', '\\n'), '\\r', '\\n'), '\\n')) AS line
            FROM {form}
        ), fields AS (
            SELECT as_of_date, upper(institution) AS institution, split(line, '[|]') AS f FROM lines
        ), typed AS (
            SELECT as_of_date, institution, lower(ptbr_decimal(get(f, 0))) AS asset_class, asset_name(ptbr_decimal(get(f, 1)), ptbr_decimal(get(f, 0))) AS asset,
                   lenient_number(ptbr_decimal(get(f, 2))) AS quantity, lenient_number(ptbr_decimal(get(f, 3))) AS avg_price,
                   lenient_number(ptbr_decimal(get(f, 4))) AS stated
            FROM fields
        ), newest AS (
            SELECT market_symbol(ticker) AS symbol, as_of_date, max_by(close, struct(price_date, fetched_at, close)) AS close
            FROM {quotes} GROUP BY ALL
        ), priced AS (
            SELECT t.*, coalesce(stated, close) AS current_price
            FROM typed t LEFT JOIN newest q ON market_symbol(t.asset) = q.symbol AND t.as_of_date = q.as_of_date
        )
        SELECT as_of_date, institution, asset_class, asset, quantity, current_price, percent_over(current_price, avg_price) AS gain,
               brl(CAST(round(CAST(current_price AS DECIMAL(18,4)) * CAST(quantity AS DECIMAL(18,4)), 2) AS DOUBLE)) AS worth
        FROM priced
    """, form=inputs.form(spark, sf_dir), quotes=quotes)


def _section(section: str, df: DataFrame, **columns: str) -> DataFrame:
    """A page part in the common shape (section, day, name, detail, value, pct, label)."""
    shape = {"day": "date", "name": "string", "detail": "string", "value": "double", "pct": "double", "label": "string"}
    picked = [
        (F.col(columns[field]) if field in columns else F.lit(None)).cast(kind).alias(field)
        for field, kind in shape.items()
    ]
    return df.select(F.lit(section).alias("section"), *picked)


def _stack(sections: list[DataFrame]) -> DataFrame:
    stacked = sections[0]
    for section in sections[1:]:
        stacked = stacked.unionByName(section)
    return stacked


def _charts(parts: dict[str, DataFrame], changes: dict[str, str]) -> list[DataFrame]:
    names = ("line", "line_change", "bars", "bars_change")
    axes = [_section(name, parts[name], value="axis_high", pct="axis_low") for name in ("line_axis", "line_change_axis")]
    return [*[_section(name, parts[name], **changes, label="label") for name in names], *axes]


@query
def page_home(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = pages.page_home(_stored_month(spark, sf_dir), {"BUILDING": "Building", "MACHINERY": "Machinery"})
    changes = {"day": "as_of_date", "name": "institution", "value": "market_value", "pct": "pct_change"}
    return _stack([
        _section("headline", parts["headline"], value="market_value", label="label"),
        _section("buttons", parts["buttons"], name="institution", value="market_value", label="label"),
        _section("classes", parts["classes"], name="asset_class", value="market_value", pct="share_pct"),
        _section("exposures", parts["exposures"], name="exposure", value="market_value", pct="share_pct"),
        *_charts(parts, changes),
    ])


@query
def page_institution(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = pages.page_institution(_stored_month(spark, sf_dir), INSTITUTION)
    changes = {"day": "as_of_date", "name": "asset", "value": "market_value", "pct": "pct_change"}
    return _stack([
        _section("headline", parts["headline"], value="market_value", label="label"),
        _section("holdings", parts["holdings"], name="asset", value="market_value", pct="pct_change"),
        _section("classes", parts["classes"], name="asset_class", value="market_value", pct="share_pct"),
        _section("exposures", parts["exposures"], name="exposure", value="market_value", pct="share_pct"),
        *_charts(parts, changes),
        _section("annual", parts["annual"], **changes, label="label"),
    ])


@query
def scope_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.scope_rows(mart_asset_line(spark, sf_dir), INSTITUTION, details_only=True)


@query
def holdings_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.holdings_table(mart_asset_label(spark, sf_dir), INSTITUTION)


@query
def headline_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = views.scope_rows(mart_home_latest(spark, sf_dir), schemas.ALL)
    return views.exactly_one(whole, "market_value").withColumn("label", text.brl(F.col("market_value")))


@query
def axis_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = mart_home_line(spark, sf_dir)
    return views.axis_ranges(line, {"amount": ("market_value", False), "percent": ("pct_change", True)})


@query
def series_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.series_names(mart_home_line(spark, sf_dir), "institution")
