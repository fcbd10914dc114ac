"""As-of joins by day: the newest fact at or before a day, within a bounded lookback."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days in a range of time; a key's facts and questions of one range meet in one task.
RANGE_DAYS = 128


def newest_before(
    asks: DataFrame, facts: DataFrame, key: str, ask_day: str, fact_day: str, values: tuple[str, ...], lookback_days: int, *,
    tiebreak: tuple[str, ...] = (), range_days: int = RANGE_DAYS,
) -> DataFrame:
    """``key``, ``ask_day``, ``fact_day`` and ``values`` for every distinct question that has an answer.

    The answer is the fact of the same key with the newest day at or before ``ask_day``, at most ``lookback_days`` back; of several on
    that day the one with the largest ``tiebreak``, then ``values``. Questions and facts without a key or a day meet nothing.

    No join compares days. Both sides are first reduced to one row per key and day, on the map side, so a key with a third of
    all rows sends no more than its days. Time is cut into ranges no shorter than the lookback. The last fact of a range is
    carried into the next one, so a window over one key and one range sees all it needs, and a key with a long history
    is many small windows, not one.
    """
    if lookback_days < 0:
        raise ValueError("a lookback is zero days or more")
    width = max(range_days, lookback_days, 1)
    slot = lambda day: F.floor(F.unix_date(F.col(day)) / width).alias("_slot")
    known = F.col(key).isNotNull()
    best = F.max(F.struct(*[F.col(c).alias(f"t{i}") for i, c in enumerate(tiebreak)], *[F.col(c).alias(c) for c in values])).alias("_fact")
    daily = facts.where(known & F.col(fact_day).isNotNull()).groupBy(key, F.col(fact_day).alias("_day")).agg(best)
    daily = daily.select(key, "_day", F.struct(F.col("_day").alias("day"), "_fact").alias("_fact"))
    ranged = daily.withColumn("_slot", slot("_day"))
    carried = ranged.groupBy(key, "_slot").agg(F.max("_fact").alias("_fact"))
    carried = carried.select(key, (F.col("_slot") + 1).alias("_slot"), F.col("_fact.day").alias("_day"), "_fact", F.lit(0).alias("_asks"))
    questions = asks.where(known & F.col(ask_day).isNotNull()).select(key, F.col(ask_day).alias("_day")).distinct()
    questions = questions.select(key, slot("_day"), "_day", F.lit(None).cast(daily.schema["_fact"].dataType).alias("_fact"), F.lit(1).alias("_asks"))
    rows = questions.unionByName(ranged.withColumn("_asks", F.lit(0))).unionByName(carried)
    so_far = Window.partitionBy(key, "_slot").orderBy("_day", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    answered = rows.withColumn("_fact", F.last("_fact", ignorenulls=True).over(so_far)).where(
        (F.col("_asks") == 1) & (F.col("_fact.day") >= F.date_sub("_day", lookback_days)))
    return answered.select(key, F.col("_day").alias(ask_day), F.col("_fact.day").alias(fact_day), *[F.col(f"_fact._fact.{c}").alias(c) for c in values])


def spread_key(key: Column) -> Column:
    """A join key for rows of which those with a null key must meet nothing: each of them gets a text of its own.

    So they are dealt out evenly instead of being gathered under null, and their frame is read only once. No other key may begin with
    the same sign, a null character.
    """
    return F.coalesce(key, F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
