"""Connected components of a graph of links, by alternating large and small stars."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portfold.llm.support import written


def _text(name: str) -> Column:
    """The node as text: joined by it, the partitioning of an aggregate is not reused, and Spark may split a hub."""
    return F.col(name).cast("string")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of the node and its neighbours."""
    pairs = _both_ways(edges)
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(_text("u").alias("k"), F.least("u", "m").alias("m"))
    return pairs.where("v > u").join(least, _text("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    keyed = least.select(_text("u").alias("k"), "m")
    tied = down.join(keyed, _text("u") == F.col("k")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every node that has a link; ``edges`` has the columns ``u`` and ``v`` of one orderable type.

    The root is the smallest node that can be reached. Each round is written to the scratch folder, so lineage stays
    short and a lost executor costs one task; only a count and a checksum come to the driver. The rounds grow with
    the logarithm of the longest chain. A hub with any number of links is one side of a plain join whose other side has one row
    per node, so Spark can split it.
    """
    edges = written(edges.where("u <> v").select("u", "v").distinct(), "links")
    before = None
    while True:
        edges = written(_small_star(_large_star(edges)).where("u <> v").distinct(), "links")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
