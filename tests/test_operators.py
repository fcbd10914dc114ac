"""Operators on hand-typed frames: empty, null, tied, short and repeated input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portfold import schemas
from portfold.operators import prices, statements, totals, views, windows

D1, D2, D3 = dt.date(2026, 1, 31), dt.date(2026, 2, 28), dt.date(2026, 4, 30)


def values(df, *columns):
    return sorted((tuple(row) for row in df.select(*columns).collect()), key=repr)


# --- statements ----------------------------------------------------------------------------------------


def test_lines_of_every_kind_of_line_end(spark):
    cells = [(1, "a\nb"), (2, "a\r\nb\rc"), (3, "a\n\nb\n"), (4, None), (5, "")]
    frame = spark.createDataFrame(cells, "id int, statement string")
    assert values(statements.explode_lines(frame), "id", "line") == sorted([
        (1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (3, ""), (3, "b"), (3, ""), (5, ""),
    ], key=repr)


def test_short_and_long_lines(spark):
    frame = spark.createDataFrame(
        [("Stock | BERK34 | 5 | 120,02 |",), ("only this",), ("a|b|c|d|e|f|g",), ("",)], "line string",
    )
    fields = statements.normalize_fields(statements.parse_fields(frame))
    assert [tuple(row) for row in fields.select(*statements.FIELDS).collect()] == [
        ("Stock", "BERK34", "5", "120.02", None),
        ("only this", None, None, None, None),
        ("a", "b", "c", "d", "e"),
        (None, None, None, None, None),
    ]


def test_case_and_exposure_order(spark):
    frame = spark.createDataFrame(
        [("Stock", "berk34", "Xp"), ("Stock", "BERK34", None), ("Renda Fixa", "Tesouro", "xp"), (None, "Abc", "x")],
        "asset_class string, asset string, institution string",
    )
    done = statements.normalize_case(statements.classify_exposure(frame))
    assert [tuple(row) for row in done.select("asset_class", "asset", "institution", "exposure").collect()] == [
        ("stock", "BERK34", "XP", "nacional"),
        ("stock", "BERK34", None, "internacional"),
        ("renda fixa", "tesouro", "XP", "nacional"),
        (None, "abc", "X", "nacional"),
    ]


def test_conform_nulls_what_does_not_fit(spark):
    schema = T.StructType([
        T.StructField("n", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("d", T.DateType()),
        T.StructField("m", T.DecimalType(18, 2)),
    ])
    frame = spark.createDataFrame(
        [("2026.0", "1.5", "2026-03-14", "3.456"), ("x", "NaN", "14/03/2026", "x"), ("99999999999", "", "", None)],
        "d2 string, x string, d string, m string",
    ).withColumnRenamed("d2", "n")
    rows = [tuple(row) for row in statements.conform(frame, schema).collect()]
    assert rows[0][:3] == (2026, 1.5, dt.date(2026, 3, 14)) and float(rows[0][3]) == 3.46
    assert rows[1] == (None, None, None, None)
    assert rows[2] == (None, None, None, None)


def test_value_of_positions(spark):
    frame = spark.createDataFrame([(130.33, 5.0), (1.005, 1.0), (None, 2.0)], "current_price double, quantity double")
    got = [row["market_value"] for row in statements.value_positions(frame).collect()]
    assert [None if v is None else float(v) for v in got] == [651.65, 1.01, None]


# --- totals --------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lots(spark):
    rows = [
        (D1, "XP", "stock", "A", 10.0, 1.0, 10.004), (D1, "XP", "stock", "A", 5.0, 4.0, 20.004),
        (D1, "XP", "fund", "F", 1.0, 7.0, 30.0), (D1, None, "stock", "A", 0.0, 3.0, 5.0),
        (D1, "ALL", "stock", "B", 1.0, 1.0, 1.0), (D2, "XP", "stock", "A", 15.0, 2.0, None),
        (D3, "XP", "stock", "A", 15.0, 2.0, 45.0),
    ]
    return spark.createDataFrame(
        rows, "as_of_date date, institution string, asset_class string, asset string, quantity double,"
        " avg_price double, market_value double",
    )


def test_totals_skip_nulls_and_round_after_adding(lots):
    got = values(totals.total_by(lots, ["as_of_date", "institution"]).withColumn("v", F.col("market_value").cast("double")), "as_of_date", "institution", "v")
    assert (D1, "XP", 60.01) in got
    assert (D2, "XP", None) in got
    assert (D1, None, 5.0) in got


def test_total_is_told_apart_from_null_and_from_its_own_name(lots):
    scoped = totals.scoped_totals(lots, ["as_of_date"], "institution", detail_scope="D", total_scope="T")
    got = values(scoped.withColumn("v", F.col("market_value").cast("double")), "as_of_date", "institution", "scope", "v")
    day = [row[1:] for row in got if row[0] == D1]
    assert sorted(day, key=repr) == sorted(
        [("XP", "D", 60.01), (None, "D", 5.0), ("ALL", "D", 1.0), ("ALL", "T", 66.01)], key=repr,
    )


def test_grouping_sets_and_union_agree(lots):
    by_sets = totals.scoped_totals(lots, ["as_of_date"], "institution")
    by_union = totals.scoped_totals_by_union(lots, ["as_of_date"], "institution")
    columns = ["as_of_date", "institution", "market_value"]
    assert values(by_sets, *columns) == values(by_union, *columns)


def test_reduced_input_gives_the_same_totals(lots):
    reduced = totals.total_by(lots, ["as_of_date", "institution", "asset"], digits=None)
    columns = ["as_of_date", "institution", "asset", "market_value"]
    base = ["as_of_date", "institution"]
    assert values(totals.scoped_totals(reduced, base, "asset", reduced=True), *columns) == values(
        totals.scoped_totals(lots, base, "asset"), *columns,
    )


def test_cost_basis_weighs_prices_and_guards_zero_quantity(lots):
    basis = totals.cost_basis(lots, ["as_of_date", "institution", "asset"])
    shown = basis.select(*[F.col(c).cast("double") if c not in ("as_of_date", "institution", "asset") else c for c in basis.columns])
    got = {tuple(row)[:3]: tuple(row)[3:] for row in shown.collect()}
    assert got[(D1, "XP", "A")] == (15.0, 2.0, 30.0, 2.0)
    assert got[(D1, None, "A")] == (0.0, None, 0.0, None)


def test_label_keeps_totals_without_a_basis(spark, lots):
    keys = ["as_of_date", "institution", "asset"]
    line = windows.pct_change(totals.scoped_totals(lots, ["as_of_date", "institution"], "asset"), ["institution", "asset"])
    latest = windows.latest_per_key(line, ["institution", "asset"])
    label = totals.label_positions(latest, totals.cost_basis(lots, keys), keys)
    got = {(r["institution"], r["asset"]): r for r in label.collect()}
    assert got[("XP", "A")]["as_of_date"] == D3 and got[("XP", "A")]["pct_change"] == 50.0
    assert got[("XP", "ALL")]["entry_cost"] is None and got[("XP", "ALL")]["pct_change"] is None


# --- windows -------------------------------------------------------------------------------------------


def test_change_skips_gaps_and_guards_its_base(spark):
    rows = [
        ("a", D1, 100.0), ("a", D2, 110.0), ("a", D3, 55.0), ("b", D1, 0.0), ("b", D2, 5.0), ("c", D1, None),
        ("c", D2, 5.0), ("c", D3, None), ("d", D1, -50.0), ("d", D2, 50.0), (None, D1, 1.0), (None, D3, 2.0),
    ]
    frame = spark.createDataFrame(rows, "k string, as_of_date date, market_value double")
    got = {(r["k"], r["as_of_date"]): r["pct_change"] for r in windows.pct_change(frame, ["k"]).collect()}
    assert got == {
        ("a", D1): None, ("a", D2): 10.0, ("a", D3): -50.0, ("b", D1): None, ("b", D2): None, ("c", D1): None,
        ("c", D2): None, ("c", D3): None, ("d", D1): None, ("d", D2): -200.0, (None, D1): None, (None, D3): 100.0,
    }


def test_latest_takes_one_row_even_when_tied_or_undated(spark):
    rows = [("a", D1, 1), ("a", D2, 1), ("a", D2, 2), ("b", None, 9), ("b", D1, 1), ("c", None, 3), (None, D1, 4)]
    frame = spark.createDataFrame(rows, "k string, as_of_date date, n int")
    expected = sorted([("a", D2, 2), ("b", D1, 1), ("c", None, 3), (None, D1, 4)], key=repr)
    assert values(windows.latest_per_key(frame, ["k"], tiebreak=("n",)), "k", "as_of_date", "n") == expected
    assert values(windows.latest_per_key_sql(frame, ["k"], "as_of_date", ("n",)), "k", "as_of_date", "n") == expected


def test_latest_with_nulls_in_every_column(spark):
    rows = [
        ("a", "x", D1, 1), ("a", "x", D2, 1), ("a", "x", D2, 2), ("a", None, None, 9), ("b", "x", None, 1),
        ("b", "x", D1, 5), (None, "x", D1, 4), (None, "x", D3, 6), (None, None, None, 7), (None, None, None, None),
    ]
    frame = spark.createDataFrame(rows, "k string, j string, as_of_date date, n int")
    latest = windows.latest_per_key(frame, ["k", "j"], tiebreak=("n",))
    assert values(latest, "k", "j", "n") == sorted(
        [("a", "x", 2), ("a", None, 9), ("b", "x", 5), (None, "x", 6), (None, None, 7)], key=repr,
    )
    assert "NestedLoop" not in latest._jdf.queryExecution().executedPlan().toString()


def test_last_point_is_one_row_even_when_tied(spark):
    frame = spark.createDataFrame([("s", D1, 1.0), ("s", D2, 2.0), ("s", D2, 3.0), ("t", D1, 4.0)], "s string, d date, v double")
    labelled = windows.last_points(frame, "s", "d", F.col("v").cast("string"), tiebreak=("v",))
    assert values(labelled, "s", "v", "label") == [("s", 1.0, ""), ("s", 2.0, ""), ("s", 3.0, "3.0"), ("t", 4.0, "4.0")]


def test_cost_of_many_digits_and_of_too_many(spark):
    rows = [("a", 0.000008912, 5e7, 1.0), ("a", 4.9e-9, 1e9, 1.0), ("b", 1e20, 1e15, 1.0), ("c", 1 / 3, 3.0, 1.0), ("d", None, 2.0, None)]
    frame = spark.createDataFrame(rows, "k string, avg_price double, quantity double, market_value double")
    basis = totals.cost_basis(frame, ["k"])
    got = {r["k"]: (float(r["entry_cost"]) if r["entry_cost"] is not None else None, r["avg_price"]) for r in basis.collect()}
    assert got == {"a": (450.5, 0.0), "b": (1e35, 1e20), "c": (1.0, 0.33), "d": (None, None)}


def test_shares_add_labels_up_first(spark):
    rows = [("ALL", D1, "x", 1.0), ("ALL", D2, "x", 1.0), ("ALL", D1, "y", 1.0), ("XP", D1, "x", 0.0)]
    frame = spark.createDataFrame(rows, "institution string, as_of_date date, exposure string, market_value double")
    shares = windows.share_of_total(frame, "institution", "exposure")
    assert values(shares, "institution", "exposure", "share_pct") == [
        ("ALL", "x", 66.67), ("ALL", "y", 33.33), ("XP", "x", None),
    ]


def test_only_the_last_point_is_labelled(spark):
    frame = spark.createDataFrame([("a", D1, 1.0), ("a", D2, 2.0), ("b", D1, 3.0)], "s string, d date, v double")
    labelled = windows.last_points(frame, "s", "d", F.col("v").cast("string"))
    assert values(labelled, "s", "d", "label") == [("a", D1, ""), ("a", D2, "2.0"), ("b", D1, "3.0")]


# --- prices --------------------------------------------------------------------------------------------


def moment(day, hour):
    return dt.datetime.combine(day, dt.time(hour))


@pytest.fixture(scope="module")
def quotes(spark):
    rows = [
        (D1, "A", 1.0, moment(D2, 1)), (D2, "A", float("nan"), moment(D2, 1)), (D1, "B", 0.0, moment(D2, 1)),
        (D1, "C", -1.0, moment(D2, 1)), (D1, "D", None, moment(D2, 1)), (D1, "E", 2.345, moment(D2, 1)),
        (D2, "E", 3.0, moment(D2, 1)),
    ]
    return spark.createDataFrame(rows, schemas.QUOTES)


def test_only_positive_numbers_are_valid_closes(quotes):
    assert values(prices.valid_closes(quotes), "ticker", "close") == [("A", 1.0), ("E", 2.345), ("E", 3.0)]


def test_latest_close_per_ticker(quotes):
    assert values(prices.latest_closes(quotes), "ticker", "price_date", "close", "as_of_date") == [
        ("A", D1, 1.0, D2), ("E", D2, 3.0, D2),
    ]


def test_window_excludes_its_end(quotes):
    assert values(prices.price_window(quotes, D2, 28), "ticker") == [("A",), ("B",), ("C",), ("D",), ("E",)]
    assert prices.price_window(quotes, D1, 28).count() == 0


def test_quotes_come_back_under_the_tickers_asked_for(spark):
    tickers = spark.createDataFrame([("PETR4",), ("AAPL.US",)], "ticker string")
    rows = [(D1, "PETR4.SA", 1.0, moment(D1, 1)), (D1, "AAPL.US", 2.0, moment(D1, 1)), (D1, "X.SA", 3.0, moment(D1, 1))]
    found = prices.quotes_for(spark.createDataFrame(rows, schemas.QUOTES), tickers)
    assert values(found, "ticker", "close") == [("AAPL.US", 2.0), ("PETR4", 1.0)]


def test_tracked_tickers(spark):
    rows = [("stock", "A"), ("stock", "A"), ("stock", ""), ("stock", None), ("fund", "F")]
    frame = spark.createDataFrame(rows, "asset_class string, asset string")
    assert values(prices.tracked_tickers(frame), "ticker") == [("A",)]


def test_merge_keeps_the_newest_fetch_and_is_idempotent(spark):
    old = spark.createDataFrame([(D1, "A", 1.0, moment(D1, 1), D1), (D2, "A", 2.0, moment(D2, 1), D2)], schemas.PRICES)
    new = spark.createDataFrame([(D1, "A", 9.0, moment(D2, 1), D2), (D1, "B", 3.0, moment(D2, 1), D2)], schemas.PRICES)
    once = prices.merge_prices(old, new)
    assert values(once, "ticker", "price_date", "close") == [("A", D1, 9.0), ("A", D2, 2.0), ("B", D1, 3.0)]
    assert values(prices.merge_prices(once, new), *once.columns) == values(once, *once.columns)


@pytest.fixture(scope="module")
def priced(spark):
    positions = spark.createDataFrame(
        [(1, "A", D1, None), (2, "A", D1, 7.0), (3, "Z", D1, None), (4, None, D1, None), (5, "A", None, None)],
        "id int, asset string, as_of_date date, current_price double",
    )
    history = spark.createDataFrame(
        [(D1, "A", 1.0, moment(D1, 1), D1), (dt.date(2026, 1, 30), "A", 2.0, moment(D1, 1), D1), (D1, None, 5.0, moment(D1, 1), D1)],
        schemas.PRICES,
    )
    return positions, history


def test_attach_price_fills_only_what_is_missing(priced):
    positions, history = priced
    filled = prices.attach_price(positions, history)
    assert values(filled, "id", "current_price") == [(1, 1.0), (2, 7.0), (3, None), (4, None), (5, None)]
    every = prices.attach_price(positions, history, mode="all")
    assert values(every, "id", "current_price") == sorted(
        [(1, 1.0), (1, 2.0), (2, 7.0), (2, 7.0), (3, None), (4, None), (5, None)], key=repr,
    )


def test_attach_price_without_prices_and_with_a_wrong_mode(spark, priced):
    positions, history = priced
    assert prices.attach_price(positions, history.limit(0)).count() == 5
    with pytest.raises(ValueError, match="mode"):
        prices.attach_price(positions, history, mode="some")


# --- views ---------------------------------------------------------------------------------------------


def test_point_lookup_wants_exactly_one(spark):
    frame = spark.createDataFrame([("ALL", 1.5), ("XP", 2.0), ("XP", 3.0)], "institution string, market_value double")
    one = F.col("institution") == "ALL"
    assert views.headline_total(frame, one) == 1.5
    assert views.exactly_one(frame.where(one), "market_value").first()[0] == 1.5
    for wrong in ("XP", "none"):
        with pytest.raises(ValueError):
            views.headline_total(frame, F.col("institution") == wrong)
        with pytest.raises(Exception, match="exactly one row"):
            views.exactly_one(frame.where(F.col("institution") == wrong), "market_value").collect()


def test_axis_ranges(spark):
    frame = spark.createDataFrame([(10.0,), (30.0,), (None,)], "v double")
    assert tuple(views.axis_range(frame, "v").first()) == (0.0, 33.0)
    assert tuple(views.axis_range(frame, "v", percent=True).first()) == (7.0, 33.0)
    flat = spark.createDataFrame([(5.0,)], "v double")
    assert tuple(views.axis_range(flat, "v", percent=True).first()) == (4.0, 6.0)


def test_required_columns(spark):
    frame = spark.createDataFrame([(1,)], "a int")
    schemas.require_columns(frame, ["a"], "chart")
    with pytest.raises(ValueError, match="chart needs columns .'b'.*'a'"):
        schemas.require_columns(frame, ["a", "b"], "chart")


def test_month_falls_back_to_the_newest(spark):
    months = spark.createDataFrame([("202601",), ("202603",)], "yyyymm string")
    assert views.resolve_month(months, "202601").first()[0] == "202601"
    assert views.resolve_month(months, "209901").first()[0] == "202603"
    assert views.resolve_month(months, None).first()[0] == "202603"
    assert views.resolve_month(months.limit(0), "202601").first()[0] is None


def test_series_names_leave_null_out(spark):
    frame = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "s string")
    assert values(views.series_names(frame, "s"), "s") == [("a",), ("b",)]
