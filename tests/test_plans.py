"""The physical plans: what is scanned, what is shuffled, and what happens to a hot key."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from portfold import schemas
from portfold.catalog import inputs
from portfold.catalog.queries import QUERIES
from portfold.functions import numbers
from portfold.operators import prices, statements, totals, windows
from portfold.plans import reports
from portfold.plans.snapshot import position_lines
from portfold.sources import spread
from tests.conftest import SMALL

EAGER = {  # these write files when called, so their plan says little about the query
    "scan_bronze_csv", "scan_snapshot", "scan_snapshot_quoted", "sql_stored_tables", "list_months", "read_month", "sink_full_refresh", "sink_month_overwrite",
    "price_history_store", "price_refresh", "page_home", "page_institution",
}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def settings(spark, **values):
    for name, value in values.items():
        spark.conf.set(f"spark.sql.{name.replace('__', '.')}", value)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_python_no_cross_join_no_single_task(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # All rows in one task only to finish a global aggregate or to sort a list of months.
    for single in re.findall(r".*\n.*Exchange SinglePartition.*\n.*", text):
        assert "Aggregate" in single


def test_latest_rows_are_found_without_sorting_the_input(spark):
    """The newest date comes from a hash aggregate; only what is left after the join back is sorted and ranked."""
    text = plan(reports.current_positions(inputs.positions(spark, SMALL), inputs.LOT_ORDER))
    assert "partial_max(as_of_date" in text and "SortAggregate" not in text
    assert text.index("WindowGroupLimit") < text.index("LeftSemi") < text.index("partial_max(as_of_date")


def test_totals_read_once_and_combine_first(spark):
    lots = inputs.positions(spark, SMALL)
    text = plan(totals.scoped_totals(lots, ["as_of_date"], "institution"))
    assert text.count("lineitem.parquet") == 1
    assert "partial_try_sum(market_value" in text
    columns = re.findall(r"lineitem.parquet.*?ReadSchema: struct<([^>]*)>", text)[0]
    assert "l_extendedprice" not in columns and "l_quantity" in columns


def test_parsing_needs_no_shuffle(spark):
    form = spark.createDataFrame([("a", "b", "c", "d", "e")], schemas.FORM)
    assert "Exchange" not in plan(position_lines(form))


def test_no_job_runs_while_a_join_is_planned(spark):
    tracker = spark.sparkContext.statusTracker()
    holdings, quotes = inputs.holdings(spark, SMALL), inputs.view_prices(spark, SMALL)
    before = set(tracker.getJobIdsForGroup(None))
    prices.attach_price(holdings, quotes)
    assert set(tracker.getJobIdsForGroup(None)) == before


def test_a_run_scans_the_form_once(spark, tmp_path):
    """Every scan of the form runs this counter once per row."""
    from portfold.plans import runs

    seen = spark.sparkContext.accumulator(0)
    path = str(tmp_path / "form")
    inputs.form(spark, SMALL).limit(300).write.parquet(path)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch
    stored = spark.read.parquet(path)
    quotes = inputs.stock_quotes(spark, SMALL).drop("as_of_date").withColumn("fetched_at", F.col("fetched_at").cast("timestamp"))
    runs.run_snapshot(spark, stored.mapInArrow(counted, stored.schema), quotes, str(tmp_path / "store"), dt.date(1998, 3, 1))
    assert seen.value == 300


WRITTEN = ["scan_bronze_csv", "list_months", "read_month", "sink_full_refresh", "page_home"]


@pytest.mark.parametrize("name", WRITTEN)
def test_plans_of_written_tables(spark, name, monkeypatch):
    """The plans of what eager queries write: no Python, no cross join, and no stage in a single task but to end a sum."""
    from pyspark.sql import DataFrameWriter

    plans = []
    for kind in ("parquet", "csv"):
        original = getattr(DataFrameWriter, kind)

        def noted(self, *args, original=original, **options):
            plans.append(plan(self._df))
            return original(self, *args, **options)
        monkeypatch.setattr(DataFrameWriter, kind, noted)
    QUERIES[name](spark, SMALL)
    assert plans
    for text in plans:
        assert "Python" not in text and "CartesianProduct" not in text and "Coalesce 1" not in text
        for single in re.findall(r".*\n.*Exchange SinglePartition.*\n.*", text):
            assert "Aggregate" in single


def test_small_prices_are_broadcast_and_positions_stay_where_they_are(spark):
    text = plan(prices.attach_price(inputs.holdings(spark, SMALL), inputs.view_prices(spark, SMALL)))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


@pytest.fixture
def hot_positions(spark):
    """Two thirds of the rows, all alike, ask for one price; many have no asset at all."""
    day = F.lit(dt.date(2026, 3, 14))
    i = F.col("id")
    asset = F.when(i % 3 < 2, "HOT").when(i % 9 == 2, None).otherwise(F.concat(F.lit("A"), (i % 50).cast("string")))
    return spark.range(0, 60_000, 1, 48).select(
        asset.alias("asset"), day.alias("as_of_date"), F.lit(None).cast("double").alias("current_price"), F.xxhash64("id").alias("lot"),
    )


def test_a_hot_key_is_split_by_adaptive_execution(spark, hot_positions):
    day = dt.date(2026, 3, 14)
    moment = dt.datetime(2026, 3, 14, 9)
    rows = [(day, name, 5.0, moment, day) for name in ["HOT", *[f"A{i}" for i in range(50)]]]
    history = spark.createDataFrame(rows, schemas.PRICES)
    settings(
        spark, adaptive__coalescePartitions__enabled=False, autoBroadcastJoinThreshold=-1, shuffle__partitions=16,
        adaptive__advisoryPartitionSizeInBytes="16k", adaptive__skewJoin__skewedPartitionThresholdInBytes="16k",
    )
    try:
        filled = prices.attach_price(hot_positions, history)
        assert "SortMergeJoin" in plan(filled)
        used = [F.max("lot"), F.max("current_price")]  # else the columns are not even read, and nothing is large
        tasks = filled.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("count"), *used).collect()
        asked = hot_positions.where("asset is not null").count()
        assert filled.where("current_price = 5.0").count() == asked and filled.count() == 60_000
        # In one task the hot key would be 40,000 rows, and those without an asset another 6,700.
        assert max(row["count"] for row in tasks) < 20_000
    finally:
        settings(
            spark, adaptive__coalescePartitions__enabled=True, autoBroadcastJoinThreshold="10MB", shuffle__partitions=8,
            adaptive__advisoryPartitionSizeInBytes="64MB", adaptive__skewJoin__skewedPartitionThresholdInBytes="256MB",
        )


def test_a_hot_key_sends_one_row_per_task_to_the_window(spark):
    """99 % of the rows share a key and a date; the shuffle before the window sees one of them per task."""
    i = F.col("id")
    rows = spark.range(0, 100_000, 1, 8).select(
        F.when(i % 100 < 99, 0).otherwise(i).alias("k"), F.lit(dt.date(2026, 1, 1)).alias("as_of_date"), i.alias("n"),
    )
    latest = windows.latest_per_key(rows, ["k"], tiebreak=("n",))
    assert latest.where("k = 0").select("n").first()[0] == 99_998
    assert latest.count() == 1_001
    assert latest.collect()
    stages = latest._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in stages


def test_a_hot_institution_is_combined_before_the_shuffle(spark):
    lots = spark.range(0, 100_000, 1, 8).select(
        F.lit(dt.date(2026, 1, 1)).alias("as_of_date"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("I"), (F.col("id") % 7).cast("string"))).otherwise("HOT").alias("institution"),
        F.lit(1).cast("decimal(18,2)").alias("market_value"),
    )
    scoped = totals.scoped_totals(lots, ["as_of_date"], "institution")
    got = {row["institution"]: int(row["market_value"]) for row in scoped.collect()}
    assert got["ALL"] == 100_000 and got["HOT"] == 66_666
    text = scoped._jdf.queryExecution().executedPlan().toString()
    assert text.rindex("partial_try_sum") > text.rindex("Exchange hashpartitioning")


def test_answers_are_parsed_before_their_lines_are_parted(spark):
    """Moments, dates and contributions once per answer; numerals without a search for blanks at every character."""
    form = spark.createDataFrame(
        [("24/02/2026 10:21:10", "14/03/2026", "XP", "Stock | A | 1,50 | 2 |\nFund | B | \t3\x7f | x | 4", "7")],
        "submitted_at string, as_of_date string, institution string, statement string, contribution string")
    lines = position_lines(form)
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    parted = plan.index("Generate explode")
    assert plan.index("dd/MM/yyyy HH:mm:ss") > parted and plan.index("dd/MM/yyyy,") > parted
    rows = [(r["quantity"], r["avg_price"], r["current_price"], r["contribution"], r["month_num"]) for r in lines.collect()]
    assert rows == [(1.5, 2.0, None, 7.0, 3), (3.0, None, 4.0, 7.0, 3)]


@pytest.mark.parametrize("name", ["contributions_by_exposure", "sql_latest_positions"])
def test_many_lines_are_dealt_out_by_their_number(spark, monkeypatch, name):
    """Lines beyond the session's partitions get more of them, with the same result; grouping by order shuffles no lines again."""
    few = QUERIES[name](spark, SMALL).collect()
    monkeypatch.setattr(spread, "PIECE_ROWS", 700)
    monkeypatch.setattr(inputs, "MANY_PARTS", 10)
    lines, before = inputs.table(spark, SMALL, "lineitem").count(), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    try:
        dealt = inputs.order_lines(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert re.search(rf"hashpartitioning\(l_orderkey#\d+L?, {-(-lines // 700)}\)", dealt)
        many = QUERIES[name](spark, SMALL)
        assert sorted(map(str, many.collect())) == sorted(map(str, few))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    if name == "contributions_by_exposure":
        plan = many._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(l_orderkey" in plan and not re.search(r"hashpartitioning\(l_orderkey#\d+L?, as_of_date", plan)


def test_the_newest_rows_alone_are_sorted_in_sql(spark):
    frame = spark.createDataFrame([("a", 1, 1), ("a", 2, 1), (None, 3, 5), (None, 3, 6)], "k string, day int, n int")
    latest = windows.latest_per_key_sql(frame, ["k"], "day", ("n",))
    assert sorted(map(tuple, latest.collect()), key=str) == sorted([("a", 2, 1), (None, 3, 6)], key=str)
    assert "LeftSemi" in latest._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_orders_are_made_before_their_lines_join(spark):
    plan = inputs.form(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.index("Join Inner")
    assert plan.index("date_format(") > joined and plan.index("initcap(") > joined and plan.index("format_number(p_retailprice") > joined


def test_lines_of_a_snapshot_are_not_shuffled_to_meet_their_prices(spark):
    """The history is stored, so its size is known when the join is planned."""
    text = plan(QUERIES["mart_snapshot"](spark, SMALL))
    assert "hashpartitioning(_asks" not in text and "BroadcastHashJoin [_asks" in text


def test_lines_parsed_in_sql_are_not_shuffled_to_meet_their_prices(spark):
    """The prices are stored, one per ticker and day; blanks around numerals are matched, and cut only where a cast would not."""
    text = plan(QUERIES["sql_functions"](spark, SMALL))
    assert re.search(r"BroadcastHashJoin \[CASE WHEN Contains\(asset", text) and "hashpartitioning(CASE WHEN Contains(asset" not in text
    assert "RLIKE(regexp_replace" not in text
    blanks = spark.createDataFrame([("\x7f12.5 \x7f",), (" \x7f\t-3\n",), ("\x7f",), ("1\x7f2",), ("\x7f5d",)], "t string")
    got = blanks.selectExpr("lenient_number(t)").collect()
    assert [r[0] for r in got] == [r[0] for r in blanks.select(numbers.to_number(F.col("t"))).collect()] == [12.5, -3.0, None, None, None]


def test_line_ends_are_replaced_only_where_there_are_any(spark):
    cells = ["a\nb", "a\r\nb\r\n", "\ra\r\r\nb", "", "plain", None, "\n\r\n\r"]
    lines = statements.explode_lines(spark.createDataFrame(list(enumerate(cells)), "n int, statement string"))
    got = sorted(map(tuple, lines.collect()), key=lambda row: row[0])
    assert sorted(got) == sorted((n, line) for n, cell in enumerate(cells) if cell is not None
                                 for line in cell.replace("\r\n", "\n").replace("\r", "\n").split("\n"))
    text = plan(lines)
    assert text.count("CASE WHEN Contains(statement") == text.count(" THEN replace(statement") == 2
