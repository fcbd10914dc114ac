"""The test tables in the shapes of this library: positions, form answers, quotes and holdings.

Every frame covers its whole source tables. The joins carry no hints: Spark broadcasts what is small and
shuffles the rest, splitting hot keys at run time.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portfold.functions import text
from portfold.operators.statements import calendar_columns
from portfold.sources.scratch import settle
from portfold.sources.spread import pieces_of, spread

# The money of the test tables.
MONEY = T.DecimalType(18, 2)

BRANDS_ABROAD = ("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5")

# (l_orderkey, l_linenumber) is not unique in the test tables, so ties need all of these.
LOT_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "quantity", "avg_price")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Below so many parts Spark broadcasts them, or shuffles little for them.
MANY_PARTS = 2_000_000


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line with its order, customer and part.

    What depends on an order, a customer or a part alone is derived before the join, once for each. Customers join the orders,
    which are fewer than their lines. Many lines are dealt out by order last, so that tasks stay small and what
    groups by order needs no further shuffle.
    """
    moment = F.col("o_orderdate")
    orders = table(spark, sf_dir, "orders").withColumns({
        "as_of_date": F.trunc(moment.cast("date"), "month"), "submitted_text": F.date_format(moment, "dd/MM/yyyy HH:mm:ss"),
    })
    orders = calendar_columns(orders).withColumn("month_text", F.date_format("as_of_date", "dd/MM/yyyy"))
    holders = table(spark, sf_dir, "customer").withColumn("holder", F.initcap("c_mktsegment"))
    heads = orders.join(holders, F.col("o_custkey") == F.col("c_custkey"))
    parts = table(spark, sf_dir, "part").withColumns({"retail": F.col("p_retailprice").cast(MONEY), "retail_text": ptbr("p_retailprice")})
    lines = table(spark, sf_dir, "lineitem")
    of_order, of_part = F.col("l_orderkey") == F.col("o_orderkey"), F.col("l_partkey") == F.col("p_partkey")
    pieces = pieces_of(lines)
    if not pieces:
        return spread(lines, "l_orderkey").join(heads, of_order).join(parts, of_part)
    if parts.count() > MANY_PARTS:
        lines = lines.repartition(pieces, "l_partkey")
    return lines.join(parts, of_part).repartition(pieces, "l_orderkey").join(heads, of_order)


def ptbr(amount: str) -> Column:
    """An amount as a form answer has it: ``1.234,50``."""
    return F.translate(F.format_number(F.col(amount), 2), ",.", ".,")


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot: one lot per order line, dated by month, held by market segment, an asset per brand."""
    worth = F.round(F.col("retail") * F.col("l_quantity").cast(MONEY), 2).cast(MONEY)
    return order_lines(spark, sf_dir).select(
        "as_of_date", "year", "month_num", "month_label",
        F.col("c_mktsegment").alias("institution"),
        F.col("p_type").alias("asset_class"),
        F.col("p_brand").alias("asset"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").cast(MONEY).alias("avg_price"),
        F.col("retail").alias("current_price"),
        worth.alias("market_value"),
        text.exposure_of(F.col("p_brand"), BRANDS_ABROAD).alias("exposure"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


def paid_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions whose lines repeat the contribution of their order; some orders have none, some zero."""
    order = F.col("l_orderkey")
    paid = F.when(order % 5 == 1, 0.0).when(order % 5 > 1, order % 1000 + 0.25)
    return positions(spark, sf_dir).withColumn("contribution", paid)


def stock_name() -> Column:
    """The asset a form answer names for a brand: a few real ones, one of them in lower case."""
    brand = F.col("p_brand")
    return (
        F.when(brand == "Brand#1", "BERK34").when(brand == "Brand#2", "ivvb11").when(brand == "Brand#3", "AAPL34")
        .otherwise(brand)
    )


def form(spark: SparkSession, sf_dir: str, around: str = "", joined: str | None = None) -> DataFrame:
    """Form answers, one per order line: a stock without a current price and a fund with one.

    The two lines are parted by either kind of line end. ``around`` stands on both sides of the numerals. What the answers are made of is
    stored under the path ``joined``, if one is given, so that the shuffles of the joins are done with before the answers are.
    """
    def within(amount: Column) -> Column:
        return F.concat(F.lit(around), amount, F.lit(around))

    stock = F.concat(
        F.lit("Stock  | "), stock_name(), F.lit(" | " + around), F.col("l_quantity").cast("int").cast("string"),
        F.lit(around + " | "), within(ptbr("l_extendedprice")), F.lit(" | "),
    )
    fund = F.concat(
        F.lit("Renda Fixa | "), F.col("p_name"), F.lit(" | 1 | "), within(F.col("retail_text")), F.lit(" | "),
        within(ptbr("l_extendedprice")),
    )
    line_end = F.when(F.col("l_linenumber") % 2 == 0, F.lit("\n")).otherwise(F.lit("\r\n"))
    lines = order_lines(spark, sf_dir).select(
        "submitted_text", "month_text", "holder", "p_brand", "p_name", "retail_text", "l_quantity", "l_extendedprice", "l_linenumber",
    )
    if joined:
        lines = settle(lines, joined)
    return lines.select(
        F.col("submitted_text").alias("submitted_at"),
        F.col("month_text").alias("as_of_date"),
        F.col("holder").alias("institution"),
        F.concat(stock, line_end, fund).alias("statement"),
        F.col("l_linenumber").cast("string").alias("contribution"),
    )


def damaged_form(spark: SparkSession, sf_dir: str, path: str) -> None:
    """A form per thousand orders as a CSV file: some rows lack fields or have too many, and some files end in open quotes.

    No more than a thousand lines meet in a file.
    """
    order = F.col("o_orderkey")
    moment = F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss")
    answer = F.concat(F.lit('"Stock | BERK34 | '), order.cast("string"), F.lit(' | 1,50 |\nFund ""A"" | X"'))
    line = F.when(order % 7 == 0, F.concat(order.cast("string"), F.lit(",only"))).when(
        order % 11 == 0, F.concat_ws(",", F.lit("x"), F.lit("y"), F.lit("XP"), answer, F.lit("1"), order.cast("string"))).otherwise(
        F.concat_ws(",", moment, F.lit("14/03/2026"), F.lit("XP"), answer, order.cast("string")))
    bucket = F.floor(order / 1000).cast("long")
    files = table(spark, sf_dir, "orders").select(bucket.alias("bucket"), F.struct(order.alias("order"), line.alias("line")).alias("row"))
    last = F.when(F.col("bucket") % 3 == 0, F.concat(F.lit('2,3,XP,"open in ""the"" middle,'), F.col("bucket").cast("string"), F.lit("\n9,9,9,9,9"))).when(
        F.col("bucket") % 3 == 1, F.concat(F.lit("4,5,NU,answer,\"open "), F.col("bucket").cast("string"), F.lit("\n8,8,8,8,8")))
    header = "timestamp,data_apuracao,instituicao_fin,resumo,aporte"
    texts = files.groupBy("bucket").agg(F.sort_array(F.collect_list("row")).alias("rows")).select(
        F.concat_ws("\n", F.lit(header), F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), last).alias("value"))
    texts.write.option("maxRecordsPerFile", 1).text(path)


def stock_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of the stocks in ``form``, on the one to seven days before each month, fetched on its first."""
    lines = order_lines(spark, sf_dir)
    quantity = F.col("l_quantity")
    fetched = F.col("as_of_date").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("l_orderkey") % 86400)
    return lines.select(
        F.date_sub("as_of_date", F.col("l_linenumber")).alias("price_date"),
        F.upper(stock_name()).alias("ticker"),
        F.when(quantity == 13, None).when(quantity == 7, 0.0).otherwise(F.col("p_retailprice")).alias("close"),
        fetched.alias("fetched_at"),
        "as_of_date",
    )


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from events, some of them null or zero."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("ticker"),
        F.col("ts").cast("date").alias("price_date"),
        F.when(kind == "error", None).when(kind == "signup", 0.0).otherwise(F.col("value")).alias("close"),
        F.col("ts").alias("fetched_at"),
        F.col("ts").cast("date").alias("as_of_date"),
        "event_id", "event_type",
    )


def holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as positions, a third of them with a price of their own."""
    purchases = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    return purchases.select(
        F.col("event_id").alias("holding_id"),
        F.concat(F.lit("T"), F.col("user_id").cast("string")).alias("asset"),
        F.col("ts").cast("date").alias("as_of_date"),
        F.col("value").alias("quantity"),
        F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("current_price"),
    )


def event_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a position: a quarter of them funds, some without an asset, a third with a price of their own."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("holding_id"),
        F.when(F.col("event_id") % 4 == 0, "fund").otherwise("stock").alias("asset_class"),
        F.when(F.col("event_type") != "click", F.concat(F.lit("T"), F.col("user_id").cast("string"))).alias("asset"),
        F.col("ts").cast("date").alias("as_of_date"), F.col("value").alias("quantity"),
        F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("current_price"),
    )


def view_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as prices: several a day for the same ticker."""
    return ticks(spark, sf_dir).where(F.col("event_type") == "view")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with both kinds of line ends."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    both = F.when(F.col("doc_id") % 2 == 1, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    return docs.select("doc_id", both.alias("text"))
