"""A uniform shuffle into shards of exact sizes.

Rows lie in partitions, and every shard gets as many rows as any other or one more. How many rows of which partition go to
which shard is drawn from the multivariate hypergeometric law, partition by partition, from the room left in the
shards: the counts that a uniform permutation of all rows would give. Each partition then permutes its rows and deals
them out by its counts, and each shard permutes what it got. So every assignment of rows to slots is equally likely.

The counts are drawn from the exact law at any number of rows. The rows are written to the scratch folder first, with their partition and place, so that they lie still: a task that
runs again deals the same rows to the same slots. Permuting is sorting by a seeded hash with the place as a tie-break.
At most ``PARTITIONS`` partitions are told apart (tasks beyond share one), so the matrix that the driver draws has no
more than that many rows, and a shard's slots are ranked in hash ranges of about ``RANGE_ROWS`` rows, never in one sort.

Equal texts are not held together: that would break both the uniformity and the exact sizes.

Defined results: null ids and texts are rows like any others; repeated rows each get a slot; with fewer rows than
shards some shards are empty; an empty table gives an empty result; input columns named like a result column go.
"""

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from portfold.llm.support import without, written

PARTITIONS = 4096
RANGE_ROWS = 65_536


def communication_matrix(rows_in: list[int], shards: int, rng: np.random.Generator) -> np.ndarray:
    """Rows to be sent from each partition to each shard; the columns sum to sizes at most one apart."""
    total = sum(rows_in)
    room = np.full(shards, total // shards, dtype=np.int64)
    room[rng.permutation(shards)[: total % shards]] += 1
    sent = np.zeros((len(rows_in), shards), dtype=np.int64)
    for i, rows in enumerate(rows_in):
        left = room.copy()
        # Shard by shard from the hypergeometric law, which the joint law factors into.
        rest, need = int(left.sum()), rows
        for j in range(shards):
            rest -= int(left[j])
            drawn = _hypergeometric(rng, int(left[j]), rest, need)
            sent[i, j] = drawn
            need -= drawn
        room -= sent[i]
    return sent


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of ``drawn`` rows are of the ``good`` ones. numpy's draw takes fewer than 10^9 of either kind."""
    if good < 10**9 and bad < 10**9:
        return int(rng.hypergeometric(good, bad, drawn)) if drawn else 0
    if not (drawn and good and bad) or drawn == good + bad:
        return min(drawn, good)
    return by_rejection(rng, good, bad, drawn)


def by_rejection(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """The same law for urns of any size: Stadlober's ratio of uniforms under a table mountain, with log-gamma.

    The odds are compared as logarithms in doubles, so the law holds to about 10^-4 of a logarithm at 10^11 rows; no approximation
    takes its place.
    """
    total, few, many = good + bad, min(good, bad), max(good, bad)
    sample = min(drawn, total - drawn)
    share = few / total
    mean = sample * share
    spread = math.sqrt((total - sample) * sample * share * (many / total) / (total - 1) + 0.5)
    # The constants of the enclosing curve, 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e).
    width = 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)

    def weight(k: int) -> float:
        return sum(map(math.lgamma, (k + 1, few - k + 1, sample - k + 1, many - sample + k + 1)))

    top = weight((sample + 1) * (few + 1) // (total + 2))
    last = min(sample, few, int(mean + 0.5 + 16 * spread))
    while True:
        u, v = 1 - rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u)
        if max(0, sample - many) <= k <= last and 2 * math.log(u) <= top - weight(k):
            break
    k = k if good <= bad else sample - k
    return k if sample == drawn else good - k


def _order(seed: int, salt: str) -> Column:
    return F.xxhash64(F.lit(f"{salt}{seed}"), F.col("_part"), F.col("_place"))


def shuffle_into_shards(df: DataFrame, shards: int = 40, *, seed: int = 0) -> DataFrame:
    """``df`` with ``shard`` (int, from 0) and ``slot`` (long, from 0 without gaps in each shard)."""
    spark: SparkSession = df.sparkSession
    # The caller's columns travel as one struct, so that none can clash with the names used here.
    row = F.struct(*[f"`{c}`" for c in without(df, ["shard", "slot"]).columns]) if without(df, ["shard", "slot"]).columns else F.struct(F.lit(0).alias("_"))
    rows = written(df.select(
        row.alias("_row"), (F.spark_partition_id() % PARTITIONS).alias("_part"), F.monotonically_increasing_id().alias("_place")), "rows")
    counts = sorted((r["_part"], r["n"]) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect())
    sent = communication_matrix([n for _, n in counts], shards, np.random.default_rng(seed))
    # One row per partition, PARTITIONS at most.
    bounds = spark.createDataFrame(
        [(part, [int(x) for x in np.cumsum(row)]) for (part, _), row in zip(counts, sent, strict=True)],
        "_part int, _ends array<bigint>",
    )
    local = Window.partitionBy("_part").orderBy(_order(seed, "local"), "_place")
    rank = F.row_number().over(local).cast("long")
    dealt = rows.withColumn("_rank", rank).join(F.broadcast(bounds), "_part").withColumn(
        "shard", F.size(F.filter("_ends", lambda end: end < F.col("_rank"))))
    total = sum(n for _, n in counts)
    bits = max(0, math.ceil(math.log2(max(1, total / shards / RANGE_ROWS))))
    dealt = dealt.withColumn("_key", _order(seed, "shard")).withColumn(
        "_range", F.shiftrightunsigned("_key", 64 - bits) if bits else F.lit(0).cast("long"))
    dealt = written(dealt.drop("_ends", "_rank"), "dealt")
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "_range").agg(F.count("*").alias("n")).select(
        "shard", "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("shard", "_range").orderBy("_key", "_part", "_place")
    slot = (F.col("_offset") + F.col("_within") - 1).cast("long")
    return dealt.withColumn("_within", F.row_number().over(within)).join(offsets, ["shard", "_range"]).select(
        *[F.col("_row")[c].alias(c) for c in without(df, ["shard", "slot"]).columns], "shard", slot.alias("slot"))


def document_sizes(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, size (bytes of the text plus 16) and CRC-32 of the text; null text has no bytes."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return df.select(
        F.col(doc_id).alias(doc_id), (F.octet_length(whole).cast("long") + 16).alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
    )


def write_shards(df: DataFrame, path: str) -> None:
    """Rows with ``shard`` and ``slot`` as one folder per shard, whose files in the order of their names have the slots in order."""
    df.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
