"""As-of prices, missing prices, contributions, returns and year-to-date on hand-typed frames."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from portfold.catalog import inputs
from portfold.operators import asof, contributions, prices, windows
from tests.conftest import SMALL
from tests.test_plans import plan, settings

POSITION = "asset string, as_of_date date, current_price double"
QUOTE = "ticker string, price_date date, close double, fetched_at timestamp"
ASSET = "asset_class string, asset string, as_of_date date"


def day(n):
    return dt.date(2025, 12, 1) + dt.timedelta(days=n)


def at(n, hour=12):
    return dt.datetime.combine(day(n), dt.time(hour))


def by_hand(asks, quotes, lookback):
    best = {}
    for ticker, when, close, fetched in quotes:
        if ticker and when and close is not None and close > 0:
            best[ticker, when] = max(best.get((ticker, when), (dt.datetime.min, 0)), (fetched, close))
    out = []
    for asset, when, own in asks:
        found = [n for n in range(lookback + 1) if when and (asset, when - dt.timedelta(days=n)) in best]
        priced = own is None and found
        taken = when - dt.timedelta(days=found[0]) if priced else None
        out.append((asset, when, best[asset, taken][1] if priced else own, taken))
    return sorted(out, key=repr)


@pytest.mark.parametrize("lookback, range_days", [(0, 1), (3, 1), (7, 7), (7, 128), (40, 5)])
def test_asof_against_loops(spark, lookback, range_days):
    rng = random.Random(lookback)
    quotes = [(rng.choice(["A", "B", "C", None]), day(rng.randrange(90)), rng.choice([None, 0.0, float(rng.randrange(1, 50))]), at(rng.randrange(90), rng.randrange(24)))
              for _ in range(150)]
    quotes += [("A", None, 5.0, at(1)), quotes[0]]
    asks = [(rng.choice(["A", "B", "C", "D", None, ""]), rng.choice([None, *map(day, range(0, 95, 3))]), rng.choice([None, None, 9.5])) for _ in range(300)]
    got = prices.attach_price_asof(spark.createDataFrame(asks, POSITION), spark.createDataFrame(quotes, QUOTE), lookback, range_days=range_days)
    assert sorted(map(tuple, got.collect()), key=repr) == by_hand(asks, quotes, lookback)


def test_asof_of_empty_sides(spark):
    none = spark.createDataFrame([], QUOTE)
    held = spark.createDataFrame([("A", day(1), None)], POSITION)
    assert [tuple(r) for r in prices.attach_price_asof(held, none).collect()] == [("A", day(1), None, None)]
    assert prices.attach_price_asof(held.limit(0), none).count() == 0
    with pytest.raises(ValueError):
        asof.newest_before(held, none, "asset", "as_of_date", "price_date", ("close",), -1)


def test_asof_plan_has_no_range_join_and_a_hot_ticker_is_reduced_first(spark):
    """Half of all positions ask for one ticker: what is shuffled into windows is its days, in ranges of time."""
    held = spark.range(200_000).select(
        F.when(F.col("id") % 2 == 0, "HOT").otherwise(F.concat(F.lit("T"), F.col("id") % 1000)).alias("asset"),
        F.date_add(F.lit(day(0)), (F.col("id") % 365).cast("int")).alias("as_of_date"), F.lit(None).cast("double").alias("current_price"))
    quotes = spark.range(3650).select(
        F.lit("HOT").alias("ticker"), F.date_add(F.lit(day(0)), (F.col("id") % 365).cast("int")).alias("price_date"),
        (F.col("id") + 1.0).alias("close"), F.lit(at(0)).alias("fetched_at"))
    priced = prices.attach_price_asof(held, quotes, range_days=30)
    text = plan(priced)
    assert "BroadcastNestedLoopJoin" not in text and "CartesianProduct" not in text and "partial_max" in text
    assert priced.where("asset = 'HOT' and current_price is not null").count() == 100_000
    found = asof.newest_before(
        held.select(F.col("asset").alias("ticker"), "as_of_date"), quotes, "ticker", "as_of_date", "price_date", ("close",), 7, range_days=30)
    parts = found.withColumn("slot", F.floor(F.unix_date("as_of_date") / 30)).groupBy("ticker", "slot").count()
    assert parts.agg(F.max("count")).first()[0] <= 30 and found.count() == 365


def test_rows_that_ask_nothing_are_dealt_out(spark):
    held = spark.range(10_000).select(F.lit(None).cast("string").alias("k"))
    keys = held.select(asof.spread_key(F.col("k")).alias("k"))
    assert keys.distinct().count() == 10_000


def test_attach_price_reads_both_sides_once(spark):
    settings(spark, autoBroadcastJoinThreshold="-1")
    try:
        text = plan(prices.attach_price(inputs.holdings(spark, SMALL), inputs.view_prices(spark, SMALL)))
        assert text.count("FileScan") == 2
        text = plan(prices.merge_prices(inputs.view_prices(spark, SMALL), inputs.view_prices(spark, SMALL)))
        assert text.count("FileScan") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_once_and_twice_find_the_same_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *map(day, range(4))]), rng.randrange(3), i) for i in range(200)]
    frame = spark.createDataFrame(rows, "k string, d date, t int, i int")
    twice = windows.latest_per_key(frame, ["k"], "d", tiebreak=("t", "i"))
    once = windows.latest_per_key(frame, ["k"], "d", tiebreak=("t", "i"), once=True)
    assert sorted(map(tuple, once.collect()), key=repr) == sorted(map(tuple, twice.collect()), key=repr)


def test_missing_prices_and_the_plan_to_fetch_them(spark):
    # 2026-01-05 is a Monday; the week before holds five weekdays, from Monday 2025-12-29 to Friday 2026-01-02.
    held = spark.createDataFrame([("stock", "A", dt.date(2026, 1, 5)), ("stock", "A", dt.date(2026, 1, 5)), ("fund", "B", dt.date(2026, 1, 5)),
                                  ("stock", "", dt.date(2026, 1, 5)), ("stock", None, dt.date(2026, 1, 5)), ("stock", "C", None)], ASSET)
    have = [("A", dt.date(2025, 12, 31), 5.0, at(1)), ("A", dt.date(2026, 1, 1), 0.0, at(1)), ("A", dt.date(2026, 1, 2), float("nan"), at(1))]
    missing = prices.missing_prices(held, spark.createDataFrame(have, QUOTE))
    days = [dt.date(2025, 12, 29), dt.date(2025, 12, 30), dt.date(2026, 1, 1), dt.date(2026, 1, 2)]
    assert sorted(map(tuple, missing.collect())) == [("A", d) for d in days]
    new_year = spark.createDataFrame([(dt.date(2026, 1, 1),)], "price_date date")
    assert prices.missing_prices(held, spark.createDataFrame(have, QUOTE), closed=new_year).count() == 3
    assert sorted(map(tuple, prices.fetch_plan(missing).collect())) == [("A", days[0], days[1], 2), ("A", days[2], days[3], 2)]
    full = spark.createDataFrame([*have, *[("A", d, 1.0, at(1)) for d in days]], QUOTE)
    assert prices.missing_prices(held, full).count() == 0
    # A weekend doesn't part two requests.
    week = spark.createDataFrame([("A", dt.date(2026, 1, 2)), ("A", dt.date(2026, 1, 5))], "ticker string, price_date date")
    assert [tuple(r) for r in prices.fetch_plan(week).collect()] == [("A", dt.date(2026, 1, 2), dt.date(2026, 1, 5), 2)]


PAID = "submitted_at timestamp, as_of_date date, institution string, exposure string, market_value decimal(38,2), contribution double"


def cents(value):
    return None if value is None else round(float(value) * 100)


def test_contributions_count_once_per_answer_and_add_up(spark):
    from decimal import Decimal as Dec
    rows = [
        (at(1), day(1), "XP", "nacional", Dec("200.00"), 10.01), (at(1), day(1), "XP", "internacional", Dec("100.00"), 10.01),
        (at(1, 13), day(1), "XP", "nacional", Dec("5.00"), 1.0),  # a second answer of that day
        (at(2), day(2), "XP", "nacional", None, 3.0), (at(2), day(2), "XP", "internacional", Dec("0.00"), 3.0),  # worth nothing: by lines
        (at(3), day(3), "XP", "nacional", Dec("7.00"), None), (at(3), day(3), "NU", "nacional", Dec("7.00"), 0.0),
    ]
    got = {(r["as_of_date"], r["institution"], r["exposure"]): (cents(r["contribution"]), cents(r["to_date"]))
           for r in contributions.contributions_by(spark.createDataFrame(rows, PAID)).collect()}
    assert got[day(1), "XP", "internacional"] == (334, 334) and got[day(1), "XP", "nacional"] == (667 + 100, 767)
    assert got[day(2), "XP", "internacional"] == (150, 484) and got[day(2), "XP", "nacional"] == (150, 917)
    assert got[day(3), "XP", "nacional"] == (0, 917) and got[day(3), "NU", "nacional"] == (0, 0)
    assert got[day(1), "ALL", "nacional"] == (767, 767) and got[day(3), "ALL", "nacional"] == (0, 917)
    assert contributions.contributions_by(spark.createDataFrame([], PAID)).count() == 0


def test_time_weighted_return_leaves_contributions_out(spark):
    from decimal import Decimal as Dec
    rows = [
        (at(1), day(1), "XP", "n", Dec("100"), 100.0), (at(2), day(2), "XP", "n", Dec("210"), 100.0),  # 10 % of its own
        (at(3), day(3), "XP", "n", Dec("105"), None),  # half is lost
        (at(4), day(4), "XP", "n", Dec("0"), 0.0), (at(5), day(5), "XP", "n", Dec("50"), 50.0),  # begins with nothing: no return
        (at(6), day(6), "XP", "n", Dec("55"), 0.0),
    ]
    got = sorted((r["as_of_date"], r["period_return"], r["chained_return"])
                 for r in contributions.time_weighted_return(spark.createDataFrame(rows, PAID)).where("institution = 'XP'").collect())
    assert [(p, c) for _, p, c in got] == [(None, 0.0), (10.0, 10.0), (-50.0, -45.0), (-100.0, -100.0), (None, -100.0), (10.0, -100.0)]


def test_year_to_date_over_a_turn_of_the_year_and_gaps(spark):
    rows = [("XP", dt.date(2023, 11, 30), 2023, 50.0), ("XP", dt.date(2023, 12, 31), 2023, 100.0), ("XP", dt.date(2024, 2, 28), 2024, 110.0),
            ("XP", dt.date(2024, 9, 30), 2024, 150.0), ("XP", dt.date(2026, 3, 31), 2026, 75.0), ("NU", dt.date(2024, 5, 31), 2024, None),
            ("NU", dt.date(2024, 6, 30), 2024, 10.0), ("NU", dt.date(2025, 6, 30), 2025, 20.0)]
    frame = spark.createDataFrame(rows, "institution string, as_of_date date, year int, market_value double")
    got = {(r["institution"], r["as_of_date"]): (None if r["base_value"] is None else float(r["base_value"]), r["ytd_pct"])
           for r in windows.since_year_start(frame, ["institution"]).collect()}
    assert [got["XP", r[1]] for r in rows[:5]] == [(50.0, 0.0), (50.0, 100.0), (100.0, 10.0), (100.0, 50.0), (150.0, -50.0)]
    assert got["NU", dt.date(2024, 6, 30)] == (None, None) and got["NU", dt.date(2025, 6, 30)] == (10.0, 100.0)
