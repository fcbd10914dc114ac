"""Date expressions. Unparseable text becomes null; nothing here raises under ANSI mode."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from portfold.schemas import MONTH_LABELS

FORM_DATE = "dd/MM/yyyy"
FORM_TIMESTAMP = "dd/MM/yyyy HH:mm:ss"


def to_day(text: Column, pattern: str | None = None) -> Column:
    """Text to date, in ISO form when no pattern is given."""
    return F.try_to_date(text, pattern) if pattern else text.try_cast("date")


def to_moment(text: Column, pattern: str | None = None) -> Column:
    """Text to timestamp, in ISO form when no pattern is given."""
    return F.try_to_timestamp(text, F.lit(pattern)) if pattern else text.try_cast("timestamp")


def month_label(day: Column) -> Column:
    return F.get(F.array(*[F.lit(label) for label in MONTH_LABELS]), F.month(day) - 1)


def yyyymm(day: Column) -> Column:
    return F.date_format(day, "yyyyMM")
