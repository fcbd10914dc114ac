"""The eight report tables.

Each is built from one of two reductions of the snapshot, ``daily_totals`` and ``current_positions``, which
are far smaller than the snapshot. A run materializes both, so the snapshot is read twice, not once per table.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portfold.operators.statements import conform
from portfold.operators.totals import allocation, cost_basis, label_positions, scoped_totals, total_by
from portfold.operators.windows import latest_per_key, pct_change, since_year_start
from portfold import schemas

DAY = ["as_of_date", "year", "month_label"]
HOLDING = ["institution", "asset_class", "asset"]

# Ties between the lots of one key on one date: the submission that came last, then the larger position.
LOT_ORDER = ("submitted_at", "quantity", "avg_price", "market_value", "line")


def daily_totals(snapshot: DataFrame, *also: Column) -> DataFrame:
    """Unrounded value per day, institution, class and asset: what all totals roll up from. ``also`` are further aggregates."""
    return total_by(snapshot, [*DAY, *HOLDING], digits=None, also=also)


def current_positions(snapshot: DataFrame, tiebreak: tuple[str, ...] = LOT_ORDER) -> DataFrame:
    """The newest lot of each institution, class and asset.

    Newest per key, not on the newest date of all: an asset that was sold keeps its last row.
    """
    return latest_per_key(snapshot, HOLDING, tiebreak=tiebreak)


def home_line(totals: DataFrame) -> DataFrame:
    """Value and percent change per day, of each institution and of the whole portfolio."""
    scoped = scoped_totals(
        totals, DAY, "institution", detail_scope=schemas.SCOPE_INSTITUTION, total_scope=schemas.SCOPE_HOME,
    )
    changed = pct_change(scoped, ["institution"], tiebreak=("scope",))
    return conform(changed.withColumn("metric", F.lit(schemas.METRIC_TOTAL)), schemas.HOME_LINE)


def home_latest(line: DataFrame) -> DataFrame:
    """The newest row of ``home_line`` per institution."""
    return latest_per_key(line, ["institution"], tiebreak=("scope",), once=True)


def home_ytd(line: DataFrame) -> DataFrame:
    """``home_line`` with what each year began with and the change since."""
    changed = since_year_start(line, ["institution"])
    return changed.select("as_of_date", "year", "month_label", "scope", "institution", "market_value", "base_value", "ytd_pct")


def home_annual(line: DataFrame) -> DataFrame:
    """``home_line`` added up per date and year. The date is part of the key, so this is yearly only with
    one snapshot a year."""
    totals = total_by(line, ["as_of_date", "year", "institution"])
    changed = pct_change(totals, ["institution"], tiebreak=("year",))
    tagged = changed.withColumns({"scope": F.lit(schemas.SCOPE_HOME), "metric": F.lit(schemas.METRIC_ANNUAL)})
    return conform(tagged, schemas.HOME_ANNUAL)


def alloc_exposure(current: DataFrame) -> DataFrame:
    return conform(allocation(current, "exposure"), schemas.ALLOC_EXPOSURE)


def alloc_class(current: DataFrame) -> DataFrame:
    return conform(allocation(current, "asset_class"), schemas.ALLOC_CLASS)


def asset_line(totals: DataFrame) -> DataFrame:
    """Value and percent change per day and institution, of each asset and of all its assets.

    Takes ``daily_totals``, which needs no further reduction before the roll-up.
    """
    scoped = scoped_totals(totals, [*DAY, "institution"], "asset", reduced=True)
    changed = pct_change(scoped, ["institution", "asset"], tiebreak=("market_value",))
    tagged = changed.withColumns({
        "metric": F.lit(schemas.METRIC_TOTAL), "scope": F.lit(schemas.SCOPE_INSTITUTION),
    })
    return conform(tagged, schemas.ASSET_LINE)


def asset_label(line: DataFrame, current: DataFrame) -> DataFrame:
    """The newest row of ``asset_line`` per asset with quantity, cost basis and return on cost."""
    keys = ["as_of_date", "institution", "asset"]
    latest = latest_per_key(line, ["institution", "asset"], tiebreak=("market_value",), once=True)
    labelled = label_positions(latest, cost_basis(current, keys), keys)
    return conform(labelled, schemas.ASSET_LABEL)


def asset_annual(line: DataFrame) -> DataFrame:
    """``asset_line`` added up per date and year."""
    totals = total_by(line, ["as_of_date", "year", "institution", "asset"])
    changed = pct_change(totals, ["institution", "asset"], tiebreak=("year",))
    tagged = changed.withColumns({
        "metric": F.lit(schemas.METRIC_ANNUAL), "scope": F.lit(schemas.SCOPE_INSTITUTION),
    })
    return conform(tagged, schemas.ASSET_ANNUAL)
