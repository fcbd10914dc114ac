"""Money paid in: by institution and exposure, and the return on what was there without it.

A contribution belongs to a form answer, and every line of the answer repeats it. So answers are put together first, by ``ANSWER``, and
each counts once, with the largest contribution that its lines state.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from portfold.functions.numbers import exact, percent_over, ratio
from portfold.operators.totals import scoped_totals
from portfold.schemas import MONEY

ANSWER = ("submitted_at", "as_of_date", "institution")


def _paid(df: DataFrame, contribution: str):
    return F.round(exact(df, contribution), 2).cast(MONEY)


def contributions_by(
    positions: DataFrame, dim: str = "exposure", answer: tuple[str, ...] = ANSWER, contribution: str = "contribution", *, dealt: bool = False,
) -> DataFrame:
    """Contributions per day, institution and ``dim``, over all institutions too, with their running total ``to_date``.

    An answer's contribution is parted among its values of ``dim`` by what their lines are worth, or by the number of lines where
    none is worth anything. Parts are differences of rounded running shares, in the order of ``dim``, so they add up to the cent.
    Answers without a contribution count as zero.

    Lines are shuffled once, by answer; no answer is larger than a form's cell. ``dealt`` says that they lie by (some columns of)
    their answer already, and in small enough partitions: then they are not shuffled again. It changes no result.
    """
    keys = list(dict.fromkeys([*answer, "as_of_date", "institution"]))
    worth = F.greatest(exact(positions, "market_value"), F.lit(0))
    lines = positions.select(*keys, dim, worth.alias("_worth"), _paid(positions, contribution).alias("_paid"))
    by_answer = lines if dealt else lines.repartition(*[F.col(k) for k in keys])
    parts = by_answer.groupBy(*keys, dim).agg(
        F.coalesce(F.try_sum("_worth"), F.lit(0)).alias("_worth"), F.count("*").alias("_lines"), F.max("_paid").alias("_paid"))
    of_answer = Window.partitionBy(*keys)
    so_far = of_answer.orderBy(F.col(dim).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    priced = F.sum("_worth").over(of_answer) > 0
    weighed = parts.withColumn("_weight", F.when(priced, F.col("_worth")).otherwise(F.col("_lines")))
    paid = F.coalesce(F.max("_paid").over(of_answer), F.lit(0))
    shares = weighed.withColumn("_share", ratio(paid * F.sum("_weight").over(so_far), F.sum("_weight").over(of_answer), 2).cast(MONEY))
    before = F.lag("_share", 1, 0).over(of_answer.orderBy(F.col(dim).asc_nulls_first()))
    parted = shares.withColumn("contribution", F.col("_share") - before)
    scoped = scoped_totals(parted, ["as_of_date", dim], "institution", "contribution")
    running = Window.partitionBy("institution", dim).orderBy("as_of_date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return scoped.select("as_of_date", "institution", dim, "contribution", F.sum("contribution").over(running).alias("to_date"))


def time_weighted_return(
    positions: DataFrame, answer: tuple[str, ...] = ANSWER, contribution: str = "contribution", digits: int = 4,
) -> DataFrame:
    """Value, contribution, return of the period and chained return, in percent, per day and institution and over all.

    A period runs from one existing day to the next; what was paid in counts at its end: (value - contribution) / value before.
    The first day and periods that begin with nothing have no return and leave the chain as it is. A window holds one row per day.
    """
    keys = list(dict.fromkeys([*answer, "as_of_date", "institution"]))
    answers = positions.select(*keys, exact(positions, "market_value").alias("market_value"), _paid(positions, contribution).alias("_paid"))
    answers = answers.groupBy(*keys).agg(F.try_sum("market_value").alias("market_value"), F.max("_paid").alias("_paid"))
    daily = answers.groupBy("as_of_date", "institution").agg(
        F.try_sum("market_value").alias("market_value"), F.coalesce(F.try_sum("_paid"), F.lit(0)).alias("_paid"))
    values = scoped_totals(daily, ["as_of_date"], "institution", reduced=True)
    paid = scoped_totals(daily, ["as_of_date"], "institution", "_paid", reduced=True)
    both = values.join(paid.select("as_of_date", F.col("institution").alias("_of"), F.col("_paid").alias("contribution")),
                       values["institution"].eqNullSafe(F.col("_of")) & (values["as_of_date"] == paid["as_of_date"])).select(
        values["as_of_date"], "institution", "market_value", "contribution")
    order = Window.partitionBy("institution").orderBy("as_of_date")
    grown = both.withColumn("_before", F.lag("market_value").over(order)).withColumn("_kept", F.col("market_value") - F.col("contribution"))
    factor = F.when(F.col("_before") != 0, F.col("_kept").cast("double") / F.col("_before").cast("double"))
    chained = F.product(F.coalesce(factor, F.lit(1.0))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return grown.select(
        "as_of_date", "institution", "market_value", "contribution", percent_over(F.col("_kept"), F.col("_before")).alias("period_return"),
        F.round((chained - 1) * 100, digits).alias("chained_return"))
