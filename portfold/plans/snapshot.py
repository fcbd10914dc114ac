"""The snapshot: form answers to typed, classified, priced position lines."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portfold.functions import dates, numbers
from portfold.operators import statements
from portfold.operators.prices import attach_price
from portfold.schemas import SNAPSHOT


def position_lines(form: DataFrame) -> DataFrame:
    """Typed statement lines with their prices as stated. No shuffle."""
    # What an answer says once is parsed once, before its lines are parted.
    answers = statements.calendar_columns(form.withColumns({
        "submitted_at": dates.to_moment(F.col("submitted_at"), dates.FORM_TIMESTAMP),
        "as_of_date": dates.to_day(F.col("as_of_date"), dates.FORM_DATE),
        "contribution": numbers.to_number(F.col("contribution")),
    }))
    fields = statements.normalize_fields(statements.parse_fields(statements.explode_lines(answers)))
    classified = statements.normalize_case(statements.classify_exposure(fields))
    typed = classified.withColumns({name: numbers.to_number(F.col(name)) for name in ("quantity", "avg_price", "current_price")})
    return typed.select(*[name for name in SNAPSHOT.names if name != "market_value"])


def price_lines(lines: DataFrame, prices: DataFrame, *, mode: str = "latest") -> DataFrame:
    """Position lines with missing prices filled from the price history, and their market value."""
    priced = attach_price(lines, prices, mode=mode)
    return statements.value_positions(priced).select(*SNAPSHOT.names)


def build_snapshot(form: DataFrame, prices: DataFrame, *, mode: str = "latest") -> DataFrame:
    """The snapshot of form answers."""
    return price_lines(position_lines(form), prices, mode=mode)
