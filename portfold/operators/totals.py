"""Aggregations. All are plain sums, combined on the map side before anything is shuffled."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portfold.functions.numbers import double_product, exact, exact_product, percent_over, ratio
from portfold.schemas import ALL, MONEY


def total_by(
    df: DataFrame, keys: list[str], value: str = "market_value", digits: int | None = 2, *, also: tuple[Column, ...] = (),
) -> DataFrame:
    """Sum of ``value`` per ``keys``. Nulls are skipped; a group of nothing but nulls sums to null.

    With ``digits=None`` the sum stays unrounded, so that it can be summed further. ``also`` are aggregates taken in the same pass.
    """
    total = F.try_sum(exact(df, value))
    return df.groupBy(*keys).agg((total if digits is None else F.round(total, digits)).alias(value), *also)


def scoped_totals(
    df: DataFrame,
    base: list[str],
    dim: str,
    value: str = "market_value",
    *,
    detail_scope: str | None = None,
    total_scope: str | None = None,
    all_label: str = ALL,
    digits: int = 2,
    reduced: bool = False,
) -> DataFrame:
    """Totals per ``base`` + ``dim`` and, in the same table, per ``base`` with ``all_label`` in ``dim``.

    The input is read and reduced once, to the detail groups; the totals are rolled up from those few rows.
    ``reduced`` says that the input is about as small as the detail groups already, which saves that step.
    ``grouping`` tells the total apart from a group whose ``dim`` is null. A ``scope`` column is added when
    the two scope labels are given.
    """
    exact_value = df.withColumn(value, exact(df, value))
    detail = exact_value if reduced else total_by(exact_value, [*base, dim], value, digits=None)
    is_total = F.grouping(dim)
    rolled = detail.groupingSets([[*base, dim], [*base]], *base, dim).agg(
        F.round(F.try_sum(value), digits).alias(value), is_total.alias("_is_total"),
    )
    columns: dict[str, Column] = {dim: F.when(F.col("_is_total") == 1, all_label).otherwise(F.col(dim))}
    if detail_scope and total_scope:
        columns["scope"] = F.when(F.col("_is_total") == 1, total_scope).otherwise(F.lit(detail_scope))
    return rolled.withColumns(columns).drop("_is_total")


def scoped_totals_by_union(
    df: DataFrame, base: list[str], dim: str, value: str = "market_value", *, all_label: str = ALL,
) -> DataFrame:
    """The detail and total rows of ``scoped_totals`` as a bag union by column name."""
    detail = total_by(df, [*base, dim], value)
    total = total_by(df, base, value).withColumn(dim, F.lit(all_label))
    return detail.unionByName(total)


def allocation(df: DataFrame, dim: str, value: str = "market_value") -> DataFrame:
    """Value per date, institution and ``dim``, and over all institutions."""
    totals = scoped_totals(df, ["as_of_date", dim], "institution", value)
    return totals.select("as_of_date", dim, value, "institution")


def cost_basis(df: DataFrame, keys: list[str]) -> DataFrame:
    """Quantity, entry cost and the quantity-weighted average and current price per ``keys``.

    Prices are null where the quantity adds up to zero. The cost is a sum of exact products; where a lot has too many
    digits for that, or the sum does, it is the sum of the doubles.
    """
    price, quantity = F.col("avg_price"), F.col("quantity")
    sums = df.select(
        *keys,
        exact(df, "quantity").alias("quantity"),
        exact_product(price, quantity).alias("cost"),
        double_product(price, quantity).alias("rough_cost"),
        exact(df, "market_value").alias("worth"),
    ).groupBy(*keys).agg(
        F.try_sum("quantity").alias("quantity"), F.try_sum("cost").alias("cost"), F.sum("rough_cost").alias("rough_cost"),
        (F.count("cost") == F.count("rough_cost")).alias("complete"), F.try_sum("worth").alias("worth"),
    )
    cost = F.when(F.col("complete"), F.col("cost"))
    in_cents = F.coalesce(F.round(cost, 2).cast(MONEY), F.round("rough_cost", 2).try_cast(MONEY))
    average = F.coalesce(ratio(cost, F.col("quantity"), 2), ratio(F.col("rough_cost"), F.col("quantity"), 2))
    return sums.select(
        *keys,
        F.round("quantity", 8).alias("quantity"),
        average.alias("avg_price"),
        in_cents.alias("entry_cost"),
        ratio(F.col("worth"), F.col("quantity"), 2).alias("current_price"),
    )


def label_positions(latest: DataFrame, basis: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the cost basis to the latest totals and add the return on cost.

    Both sides hold one row per key, so no key can be hot. Rows without a basis, such as the all-assets
    totals, keep nulls. The return is taken on the entry cost as shown, in whole cents.
    """
    details = basis.select(*keys, "quantity", "avg_price", "entry_cost", "current_price")
    joined = latest.drop("pct_change").join(details, on=keys, how="left")
    return joined.withColumn("pct_change", percent_over(exact(latest, "market_value"), F.col("entry_cost")))
