"""Mixing sources to target weights by temperature.

A source with the share p of all tokens gets a weight in proportion to p^a. The exponent a lies between 0 (all sources alike) and 1
(as they are). It is found by bisection: the largest a whose weights reach the wished entropy, raised if a source
would otherwise be repeated more often than allowed. Each step cuts the bracket into 16 parts with one aggregate over
the table of sources, so neither the sources nor their shares come to the driver, only sums.

The weights are realised as budgeted block permutations. Each source is dealt into blocks of about ``BLOCK_DOCS``
documents by a hash of id and text. An epoch visits the blocks in the order of a seeded hash, and each block's
documents likewise. A source whose share of the budget is 2.4 times its size gives two whole epochs and the
first 40 % of a third, cut between documents, never above the budget. The cut of a source is one block and one key in it, so
each document is decided by one joined row per source. Sorting by (source, epoch, block_key, order_key) gives the order.

Only table rows of one boundary block, or rows of some ten thousand blocks, ever meet in a window. Texts are never shuffled for a
decision; a hot source is one side of a plain join whose other side has one row per source.

Defined results: tokens are words; null sources are a source of their own; documents without words weigh nothing and
come along with their block; a source without words has no weight and goes; equal rows have equal keys, and are taken or left together; an empty table gives an
empty result; input columns named like a result column are replaced.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from portfold.llm.support import without, words, written

BLOCK_DOCS = 1024
RANGE_BLOCKS = 65_536
_PARTS = 16
_STEPS = 5
RESULT = ("epoch", "block_key", "order_key")


def _source_key(source: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("null"))


def _sums(shares: DataFrame, exponents: list[float]) -> list[tuple[float, float]]:
    """For each exponent a: the sum of p^a, and of p^a ln p."""
    p = F.col("share")
    row = shares.agg(*[f for a in exponents for f in (F.sum(F.pow(p, a)), F.sum(F.pow(p, a) * F.log(p)))]).first()
    return list(zip(row[::2], row[1::2], strict=True))


def entropy(exponent: float, total: float, logs: float) -> float:
    """Entropy of the weights p^a / total, from the sums of p^a and of p^a ln p."""
    return math.log(total) - exponent * logs / total


def _largest(shares: DataFrame, holds) -> float:
    """The largest exponent in [0, 1] for which ``holds``, which is true up to some exponent and false above it."""
    low, high = 0.0, 1.0
    if holds(1.0, *_sums(shares, [1.0])[0]):
        return 1.0
    for _ in range(_STEPS):
        step = (high - low) / _PARTS
        grid = [low + step * k for k in range(1, _PARTS)]
        true = [a for a, (total, logs) in zip(grid, _sums(shares, grid), strict=True) if holds(a, total, logs)]
        low = max(true, default=low)
        high = low + step
    return low


def exponent(
    shares: DataFrame, *, budget_ratio: float, entropy_share: float | None, max_repeat: float | None,
) -> float:
    """The exponent for shares (``share`` > 0) such that the entropy is at least ``entropy_share`` of the largest
    possible and no source is repeated more than ``max_repeat`` times; the repetition limit goes first.

    ``budget_ratio`` is the budget over the tokens there are; above ``max_repeat`` nothing fits: ``ValueError``.
    """
    n, smallest = shares.agg(F.count("*"), F.min("share")).first()
    if max_repeat is not None and budget_ratio > max_repeat:
        raise ValueError(f"the budget is {budget_ratio:g} times the tokens; sources may be repeated {max_repeat:g} times")
    found = 1.0
    if entropy_share is not None:
        wished = entropy_share * math.log(n) - 1e-12
        found = _largest(shares, lambda a, total, logs: entropy(a, total, logs) >= wished)
    if max_repeat is not None:
        # The smallest source is repeated most: budget * p^a / total / p.
        def too_often(a: float, total: float, _: float) -> bool:
            return budget_ratio * smallest ** (a - 1) / total > max_repeat * (1 + 1e-12)
        over = _largest(shares, too_often)
        if found <= over:
            found = min(1.0, over + _PARTS ** -_STEPS) if over > 0 or too_often(0.0, float(n), 0.0) else found
    return found


def _hash(seed: int, salt: str, *columns: Column) -> Column:
    return F.xxhash64(F.lit(f"{salt} {seed}"), *columns)


def _keyed(df: DataFrame, doc_id: str, source: str, text: str, seed: int) -> DataFrame:
    """Every row as one struct ``_row``, so that none of its columns can clash, with ``_source``, ``_key`` and ``_words``."""
    id_, whole = F.col(f"`{doc_id}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(
        F.struct(*[f"`{c}`" for c in df.columns]).alias("_row"), _source_key(source).alias("_source"),
        _hash(seed, "document", id_.cast("string"), id_.isNull(), whole).alias("_key"),
        F.size(words(whole)).cast("long").alias("tokens"),
    )


def _block(seed: int) -> Column:
    return F.pmod(_hash(seed, "block", F.col("_key")), F.col("_blocks"))


def plan(
    df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", *, budget: int | None = None,
    entropy_share: float | None = 0.95, max_repeat: float | None = 2.0, seed: int = 0,
) -> DataFrame:
    """One row per source: its tokens, weight, target tokens, whole epochs, and where the last epoch is cut.

    ``budget`` is in tokens; as many as there are if none is given.
    """
    rows = _keyed(df, doc_id, source, text, seed).select("_source", "_key", "tokens")
    rows = written(rows, "documents")
    totals = written(rows.groupBy("_source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "sources")
    all_tokens = totals.agg(F.sum("tokens")).first()[0] or 0
    budget = all_tokens if budget is None else budget
    shares = totals.where("tokens > 0").withColumn("share", F.col("tokens") / F.lit(float(max(1, all_tokens))))
    weight = F.lit(0.0)
    if all_tokens:
        a = exponent(shares, budget_ratio=budget / all_tokens, entropy_share=entropy_share, max_repeat=max_repeat)
        total = _sums(shares, [a])[0][0]
        share = F.col("tokens") / F.lit(float(all_tokens))
        weight = F.when(F.col("tokens") > 0, F.pow(share, a) / F.lit(total)).otherwise(0.0)
    # A source at its natural share must not lose an epoch to rounding.
    target = F.floor(F.lit(budget * (1 + 1e-12)) * F.col("weight") + 1e-6).cast("long")
    sources = totals.withColumn("weight", weight).withColumn("target", target).withColumns({
        "epochs": F.when(F.col("tokens") > 0, F.expr("target div tokens")).otherwise(F.lit(0).cast("long")),
        "rest": F.when(F.col("tokens") > 0, F.expr("target % tokens")).otherwise(F.lit(0).cast("long")),
        "_blocks": F.ceil(F.col("docs") / BLOCK_DOCS).cast("long"),
    })
    sources = written(sources, "weights")

    # The cut: the first block, in the order of the last epoch, with which a source would exceed its rest.
    placed = rows.join(sources.select("_source", "_blocks", "epochs", "rest"), "_source").withColumn("block", _block(seed))
    blocks = placed.groupBy("_source", "block").agg(
        F.sum("tokens").alias("tokens"), F.first("epochs").alias("epochs"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("block_key", _block_key(seed, F.col("epochs")))
    # Blocks are added up in ranges of their keys, and ranges among each other, so no window holds more than some of a source.
    most = sources.agg(F.max("_blocks")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, most / RANGE_BLOCKS))))
    blocks = written(blocks.withColumn("_range", F.shiftright("block_key", 64 - bits) if bits else F.lit(0).cast("long")), "blocks")
    earlier = Window.partitionBy("_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("_source", "_range").agg(F.sum("tokens").alias("n")).select(
        "_source", "_range", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    order = Window.partitionBy("_source", "_range").orderBy("block_key", "block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("tokens").over(order), F.lit(0))
    summed = blocks.withColumn("_within", before).join(offsets, ["_source", "_range"]).withColumn("before", F.col("offset") + F.col("_within"))
    cuts = summed.where("before + tokens > rest").groupBy("_source").agg(
        F.min(F.struct("block_key", "block", F.col("rest") - F.col("before"))).alias("cut"))
    cuts = cuts.select("_source", F.col("cut.block_key").alias("cut_key"), F.col("cut.block").alias("cut_block"),
                       F.col("cut.col3").alias("room"))
    cuts = written(cuts, "cuts")
    boundary = placed.join(cuts, (placed["_source"] == cuts["_source"]) & (placed["block"] == cuts["cut_block"])).select(
        placed["_source"], "room", "tokens", _order_key(seed, F.col("epochs")).alias("order_key"))
    by_key = boundary.groupBy("_source", "order_key").agg(F.sum("tokens").alias("tokens"), F.first("room").alias("room"))
    up_to = F.sum("tokens").over(
        Window.partitionBy("_source").orderBy("order_key").rowsBetween(Window.unboundedPreceding, 0))
    last = by_key.withColumn("up_to", up_to).where("up_to <= room").groupBy("_source").agg(F.max("order_key").alias("cut_order"))
    return written(sources.join(cuts.drop("room"), "_source", "left").join(last, "_source", "left"), "plan")


def _block_key(seed: int, epoch: Column) -> Column:
    return _hash(seed, "visit", epoch.cast("long"), F.col("_source"), F.col("block"))


def _order_key(seed: int, epoch: Column) -> Column:
    return _hash(seed, "order", epoch.cast("long"), F.col("_key"))


def mix(
    df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", *, budget: int | None = None,
    entropy_share: float | None = 0.95, max_repeat: float | None = 2.0, seed: int = 0,
) -> DataFrame:
    """The rows of ``df``, each once per epoch that takes it, with ``epoch`` (int, from 0), ``block_key`` and ``order_key``."""
    sources = plan(df, doc_id, source, text, budget=budget, entropy_share=entropy_share, max_repeat=max_repeat, seed=seed)
    columns = [F.col("_row")[c].alias(c) for c in without(df, RESULT).columns]
    decided = sources.select("_source", "_blocks", "epochs", "rest", "cut_key", "cut_block", "cut_order")
    rows = _keyed(df, doc_id, source, text, seed).select("_row", "_source", "_key").join(decided, "_source")
    rows = rows.withColumn("block", _block(seed)).withColumn("_last", _block_key(seed, F.col("epochs")))
    cut, at = F.col("cut_key"), F.col("_last")
    earlier = cut.isNull() | (at < cut) | ((at == cut) & (F.col("block") < F.col("cut_block")))
    partly = (F.col("block") == F.col("cut_block")) & (_order_key(seed, F.col("epochs")) <= F.col("cut_order"))
    begun = (F.col("rest") > 0) & cut.isNotNull()
    times = F.col("epochs") + F.when(begun & (earlier | F.coalesce(partly, F.lit(False))), 1).otherwise(0)
    taken = rows.withColumn("_times", times).where("_times > 0").withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_times") - 1)))
    return taken.select(
        *columns, F.col("epoch").cast("int").alias("epoch"), _block_key(seed, F.col("epoch")).alias("block_key"),
        _order_key(seed, F.col("epoch")).alias("order_key"),
    )


def in_order(mixed: DataFrame) -> DataFrame:
    """Mixed rows in the order of their blocks, the blocks of all sources and epochs among each other, dealt by range."""
    return mixed.repartitionByRange("block_key", "order_key").sortWithinPartitions("block_key", "order_key")
