"""A whole run: form answers to snapshot, snapshot to report tables, all in the store."""

import datetime as dt
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from portfold.functions.dates import yyyymm
from portfold.operators import prices as price_ops
from portfold.operators.gates import Gate
from portfold.operators.windows import latest_per_key
from portfold.plans import reports
from portfold.plans.snapshot import position_lines, price_lines
from portfold.schemas import REPORTS, SNAPSHOT
from portfold.sources import store, versions
from portfold.sources.scratch import materialize, scratch_folder

MONTH_KEY = "state_month"
FIRST = "_first"


def refresh_prices(
    spark: SparkSession, path: str, quotes: DataFrame, positions: DataFrame, as_of: dt.date, lookback_days: int = 7,
) -> DataFrame:
    """Add the newest valid close of every tracked ticker to the price history and return the history.

    The prices are those of ``as_of``, whenever they were fetched, so a past month can be rebuilt.
    """
    window = price_ops.price_window(quotes, as_of, lookback_days)
    wanted = price_ops.quotes_for(window, price_ops.tracked_tickers(positions))
    return store.upsert_prices(spark, path, price_ops.latest_closes(wanted, as_of=as_of))


def run_snapshot(
    spark: SparkSession, form: DataFrame, quotes: DataFrame, root: str, as_of: dt.date, gates: Sequence[Gate] = (),
) -> str:
    """Refresh the price history, then rebuild ``<root>/snapshot``. Returns the path of its new version.

    The form is scanned and parsed once; the parsed lines serve the tickers and the snapshot. If a gate breaks, the snapshot
    before stays in force.
    """
    with scratch_folder(spark) as scratch:
        lines = materialize(position_lines(form), f"{scratch}/lines")
        history = refresh_prices(spark, f"{root}/prices", quotes, lines, as_of)
        return store.write_full(price_lines(lines, history), f"{root}/snapshot", gates)


def _publish(spark: SparkSession, totals: DataFrame, current: Callable[[], DataFrame], root: str) -> dict[str, str]:
    """Build and store the eight report tables from stored daily totals and current positions.

    Tables that do not depend on each other are written at the same time: each is a small job that would not
    fill a cluster by itself. ``current`` is called in one of the threads.
    """
    label = store.run_label_of(totals)

    def publish(name: str, df: DataFrame) -> str:
        return store.write_month(df, root, name, label)

    def stored(name: str) -> DataFrame:
        return store.read_month(spark, root, name, REPORTS[name], label)

    with ThreadPoolExecutor(max_workers=4) as pool:
        current_job = pool.submit(current)
        jobs = {
            "home_line": pool.submit(publish, "home_line", reports.home_line(totals)),
            "asset_line": pool.submit(publish, "asset_line", reports.asset_line(totals)),
        }
        now = current_job.result()
        jobs |= {
            "alloc_exposure": pool.submit(publish, "alloc_exposure", reports.alloc_exposure(now)),
            "alloc_class": pool.submit(publish, "alloc_class", reports.alloc_class(now)),
        }
        jobs["home_line"].result()
        home = stored("home_line")
        jobs["home_latest"] = pool.submit(publish, "home_latest", reports.home_latest(home))
        jobs["home_annual"] = pool.submit(publish, "home_annual", reports.home_annual(home))
        jobs["asset_line"].result()
        assets = stored("asset_line")
        jobs["asset_label"] = pool.submit(publish, "asset_label", reports.asset_label(assets, now))
        jobs["asset_annual"] = pool.submit(publish, "asset_annual", reports.asset_annual(assets))
        return {name: jobs[name].result() for name in REPORTS}


def run_reports(
    spark: SparkSession, snapshot: DataFrame, root: str, lot_order: tuple[str, ...] = reports.LOT_ORDER,
) -> dict[str, str]:
    """Build and store the eight report tables of a whole snapshot under the run label. Returns their paths by name."""
    with scratch_folder(spark) as scratch:
        totals = materialize(reports.daily_totals(snapshot), f"{scratch}/totals")
        return _publish(
            spark, totals, lambda: materialize(reports.current_positions(snapshot, lot_order), f"{scratch}/current"), root)


def _first_of(lot_order: tuple[str, ...]) -> str:
    return lot_order[0] if lot_order else "as_of_date"


def _newest_lots(dated: DataFrame, totals: DataFrame, lot_order: tuple[str, ...], path: str) -> DataFrame:
    """The newest lot of each holding within each month.

    ``totals`` say for every holding and day what its greatest first column of ``lot_order`` is. From them comes, by month, which
    rows can be the newest: so of ``dated`` only those few are sorted. What is sought is stored under ``path`` first, so that
    Spark knows its size when it plans the join, and broadcasts it if it is small.
    """
    keys = [*reports.HOLDING, MONTH_KEY]
    newest = latest_per_key(totals.select(*keys, "as_of_date", FIRST), keys, tiebreak=(FIRST,), once=True)
    names = {name: f"_{name}" for name in (*keys, "as_of_date")}
    sought = materialize(newest.withColumnsRenamed(names), path)
    same = F.col(_first_of(lot_order)).eqNullSafe(F.col(FIRST))
    for name, other in names.items():
        same = same & F.col(name).eqNullSafe(F.col(other))
    return latest_per_key(dated.join(sought, same, "left_semi"), keys, tiebreak=lot_order, once=True)


def add_months(
    spark: SparkSession, lines: DataFrame, root: str, lot_order: tuple[str, ...] = reports.LOT_ORDER,
) -> dict[str, str]:
    """The report tables after months were added or delivered anew, without reading the others again. Returns their paths by name.

    ``lines`` are all snapshot lines of the months they are dated in. ``<root>/state`` keeps two reductions by month, in versions: the
    daily totals, and the newest lot of each holding within the month. The months of ``lines`` are replaced there, and the tables are built
    from the state: totals add up over months, and the newest lot of all is the newest of the months' newest. Lines without
    a date form a month of their own. A run that dies can be repeated; runs for different months may overlap.
    """
    month = versions.month_of(F.col("as_of_date"), yyyymm)
    with scratch_folder(spark) as scratch:
        reduced = reports.daily_totals(lines, F.max(_first_of(lot_order)).alias(FIRST))
        totals = materialize(reduced.withColumn(MONTH_KEY, month), f"{scratch}/totals")
        lots = materialize(_newest_lots(lines.withColumn(MONTH_KEY, month), totals, lot_order, f"{scratch}/newest"), f"{scratch}/lots")
        totals = totals.drop(FIRST)
        # No more rows than the calendar has months.
        months = {row[0] for row in totals.select(MONTH_KEY).distinct().collect()}
        paths = {"totals": f"{root}/state/totals", "lots": f"{root}/state/lots"}
        frames = {"totals": totals, "lots": lots}
        now = {name: versions.update(spark, paths[name], months, lambda _, name=name: frames[name], MONTH_KEY) for name in paths}
        state = {name: versions.read(spark, paths[name], frames[name].drop(MONTH_KEY).schema, now[name]) for name in paths}
        newest = latest_per_key(state["lots"], reports.HOLDING, tiebreak=lot_order)
        return _publish(spark, state["totals"], lambda: materialize(newest, f"{scratch}/current"), root)


def run_all(
    spark: SparkSession, form: DataFrame, quotes: DataFrame, root: str, as_of: dt.date, gates: Sequence[Gate] = (),
) -> dict[str, str]:
    """Form answers to report tables."""
    path = run_snapshot(spark, form, quotes, root, as_of, gates)
    return run_reports(spark, spark.read.schema(SNAPSHOT).parquet(path), root)
