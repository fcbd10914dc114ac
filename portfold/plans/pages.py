"""The data behind the dashboard pages, as DataFrames."""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portfold.functions import text
from portfold.operators import views, windows
from portfold.schemas import ALL, REPORTS
from portfold.sources import store


@dataclass(frozen=True)
class Page:
    """A page shows the whole portfolio (scope value ``ALL``) or one institution."""

    title: str
    institution: str


# The pages of the dashboard.
PAGES = {
    "home": Page("Principal", "ALL"),
    "page_1": Page("XP", "XP"),
    "page_2": Page("Nubank", "NUBANK"),
    "page_3": Page("Clear", "CLEAR"),
    "page_4": Page("Binance", "BINANCE"),
}


def load_month(spark: SparkSession, root: str, month: str) -> dict[str, DataFrame]:
    """All report tables of one month."""
    return {name: store.read_month(spark, root, name, schema, month) for name, schema in REPORTS.items()}


# The institutions that get a navigation button, with their titles. Binance has a page, but no button.
BUTTONS = {page.institution: page.title for name, page in PAGES.items() if name in ("page_1", "page_2", "page_3")}


def page_home(tables: dict[str, DataFrame], buttons: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The home page. ``buttons`` maps the institutions that get a navigation button to their titles, by default ``BUTTONS``.

    Every configured button has exactly one value: the query fails for an institution without a row or with several.
    Lines and bars show every institution, pies only the whole portfolio.
    """
    latest = tables["home_latest"]
    line, bars = tables["home_line"], tables["home_annual"]
    return {
        "headline": _headline(latest.where(F.col("institution") == ALL)),
        "buttons": _buttons(latest, BUTTONS if buttons is None else buttons),
        **_pies(tables, ALL),
        "line": _line_chart(line, "institution"),
        "line_axis": views.axis_range(line, "market_value"),
        "line_change": _line_chart(line, "institution", percent=True),
        "line_change_axis": views.axis_range(line, "pct_change", percent=True),
        "bars": _bar_chart(bars),
        "bars_change": _bar_chart(bars, percent=True),
    }


def page_institution(tables: dict[str, DataFrame], institution: str) -> dict[str, DataFrame]:
    """The page of one institution. ``bars`` are drawn from the line table; ``annual`` has the table made for it."""
    labels = tables["asset_label"]
    line = views.scope_rows(tables["asset_line"], institution)
    return {
        "headline": _headline(views.scope_rows(labels, institution).where(F.col("asset") == ALL)),
        "holdings": views.holdings_table(labels, institution),
        **_pies(tables, institution),
        "line": _line_chart(line, "asset"),
        "line_axis": views.axis_range(line, "market_value"),
        "line_change": _line_chart(line, "asset", percent=True),
        "line_change_axis": views.axis_range(line, "pct_change", percent=True),
        "bars": _bar_chart(line),
        "bars_change": _bar_chart(line, percent=True),
        "annual": _bar_chart(views.scope_rows(tables["asset_annual"], institution)),
    }


def all_pages(tables: dict[str, DataFrame]) -> dict[str, dict[str, DataFrame]]:
    """Every page of ``PAGES``, as frames that are computed when they are read."""
    return {
        name: page_home(tables) if page.institution == ALL else page_institution(tables, page.institution)
        for name, page in PAGES.items()
    }


def _buttons(latest: DataFrame, buttons: dict[str, str]) -> DataFrame:
    wanted = latest.sparkSession.createDataFrame(list(buttons.items()), "institution string, title string")
    values = latest.select("institution", "market_value", F.lit(1).alias("_found"))
    rows = F.count("_found")
    problem = F.concat(F.lit("button of "), F.col("institution"), F.lit(" needs exactly one row, found "), rows.cast("string"))
    one = wanted.join(values, "institution", "left").groupBy("institution", "title").agg(
        F.when(rows == 1, F.max("market_value")).otherwise(F.raise_error(problem)).alias("market_value"))
    return one.select("institution", "market_value", text.titled_brl(F.col("title"), F.col("market_value")).alias("label"))


def _label(percent: bool) -> Column:
    return text.percent_label(F.col("pct_change")) if percent else text.amount_label(F.col("market_value"))


def _line_chart(df: DataFrame, series: str, *, percent: bool = False) -> DataFrame:
    """Rows with ``label``: filled on the last point of every series."""
    return windows.last_points(df, series, "as_of_date", F.coalesce(_label(percent), F.lit("")), tiebreak=("market_value",))


def _bar_chart(df: DataFrame, *, percent: bool = False) -> DataFrame:
    """Rows with ``label``: filled on every bar."""
    return df.withColumn("label", _label(percent))


def _headline(rows: DataFrame) -> DataFrame:
    one = views.exactly_one(rows, "market_value", "headline")
    return one.withColumn("label", text.brl(F.col("market_value")))


def _pies(tables: dict[str, DataFrame], institution: str) -> dict[str, DataFrame]:
    def pie(name: str, dim: str) -> DataFrame:
        return windows.share_of_total(views.scope_rows(tables[name], institution), "institution", dim)

    return {"classes": pie("alloc_class", "asset_class"), "exposures": pie("alloc_exposure", "exposure")}
