"""Relations that hold between the tables, over the whole smallest test tables."""

import pytest
from pyspark.sql import functions as F

from portfold import schemas
from portfold.catalog import inputs
from portfold.operators import totals, windows
from portfold.plans import pages, reports, runs
from portfold.sources import store
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def lots(spark):
    return inputs.positions(spark, SMALL).cache()


@pytest.fixture(scope="module")
def current(lots):
    return reports.current_positions(lots, inputs.LOT_ORDER).cache()


def cents(column="market_value"):
    return F.sum(F.round(F.col(column) * 100).cast("long"))


def test_all_is_the_sum_of_the_institutions(lots):
    line = reports.home_line(lots)
    whole = F.col("institution") == schemas.ALL
    apart = line.groupBy("as_of_date").agg(
        cents().alias("both"), F.sum(F.when(whole, F.round(F.col("market_value") * 100).cast("long"))).alias("whole"),
    )
    assert apart.where("both <> 2 * whole").count() == 0


def test_allocations_cut_the_same_value_two_ways(current):
    by_class = reports.alloc_class(current).groupBy("as_of_date", "institution").agg(cents().alias("c"))
    by_exposure = reports.alloc_exposure(current).groupBy("as_of_date", "institution").agg(cents().alias("e"))
    joined = by_class.join(by_exposure, ["as_of_date", "institution"], "full")
    assert joined.where("c is distinct from e").count() == 0
    assert joined.count() > 0


def test_shares_add_up_to_a_hundred(current):
    shares = windows.share_of_total(totals.allocation(current, "asset_class"), "institution", "asset_class")
    sums = shares.groupBy("institution").agg(F.sum("share_pct").alias("s"), F.count("*").alias("n"))
    assert sums.where("abs(s - 100) > 0.005 * n + 1e-9").count() == 0


def test_report_run_equals_the_tables_built_one_by_one_and_can_be_repeated(spark, lots, current, tmp_path):
    root = str(tmp_path)
    line = reports.home_line(lots)
    assets = reports.asset_line(reports.daily_totals(lots))
    expected = {
        "home_line": line,
        "home_latest": reports.home_latest(line),
        "home_annual": reports.home_annual(line),
        "alloc_exposure": reports.alloc_exposure(current),
        "alloc_class": reports.alloc_class(current),
        "asset_line": assets,
        "asset_label": reports.asset_label(assets, current),
        "asset_annual": reports.asset_annual(assets),
    }
    for _ in range(2):
        runs.run_reports(spark, lots, root, inputs.LOT_ORDER)
        months = [row[0] for row in store.list_months(spark, root, "home_line").collect()]
        assert months == [store.run_label_of(lots)]
        tables = pages.load_month(spark, root, months[0])
        for name, frame in expected.items():
            assert frame.columns == schemas.REPORTS[name].names
            assert tables[name].exceptAll(frame).count() == 0, name
            assert tables[name].count() == frame.count(), name
