"""Exact deduplication by a 128-bit content hash, with the bytes compared inside every group.

Rows are grouped by the MD5 of their text. Inside groups of more than one row the smallest and the largest text
are compared byte by byte; both are combined on the map side, so a group with a third of all rows sends two
texts per task and is never gathered anywhere. A hash whose texts differ is split by the text itself.

Only ids and hashes are grouped and joined, never the texts. No window and no list of a group's members is used;
the join back to the rows has one row per group on one side, so Spark may split a hot group's rows at will.

Defined results: null text counts as empty; a null id is smaller than any other (it stays only in a group without
ids); of repeated rows with the id that stays, one stays; an empty table gives an empty result; other input
columns are left out of the marks, whatever their names, and kept by ``drop_copies``.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portfold.llm.support import written


def md5_bytes(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _hashed(df: DataFrame, doc_id: str, text: str, content_hash: Callable[[Column], Column]) -> DataFrame:
    """One slim row per row of ``df``: id, hashes, and as ``variant`` the text where a content hash has several texts."""
    slim = df.select(
        F.col(doc_id).alias("id"), content_hash(_text(text)).alias("hash"),
        F.sha2(_text(text).cast("binary"), 256).alias("sha"),
    )
    rows = written(slim, "hashes")
    repeated = rows.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    texts = df.select(content_hash(_text(text)).alias("hash"), _text(text).alias("text"))
    # Joined and grouped by other forms of the hash, so that no partitioning is reused: a hot group may be split for the
    # join and is combined before the next shuffle.
    again = repeated.select(F.hex("hash").alias("hex"))
    ends = texts.withColumn("hex", F.hex("hash")).join(again, "hex", "left_semi").groupBy(F.reverse("hex").alias("hex")).agg(
        F.min("text").alias("a"), F.max("text").alias("z"))
    colliding = written(ends.where("a <> z").select(F.unhex(F.reverse("hex")).alias("hash")), "colliding")
    if colliding.isEmpty():
        return rows.withColumn("variant", F.lit(None).cast("string"))
    tagged = colliding.withColumn("collides", F.lit(True))
    again = df.select(
        F.col(doc_id).alias("id"), content_hash(_text(text)).alias("hash"),
        F.sha2(_text(text).cast("binary"), 256).alias("sha"), _text(text).alias("text"),
    )
    variant = F.when(F.col("collides"), F.col("text"))
    return again.join(tagged, "hash", "left").select("id", "hash", "sha", variant.alias("variant"))


def _groups(rows: DataFrame, keep: str) -> tuple[DataFrame, DataFrame]:
    """Counted rows (hash, variant, sha, id, n) and groups (hash, variant, keep_id, n_keep, group_size)."""
    counted = rows.groupBy("hash", "variant", "sha", "id").agg(F.count("*").alias("n"))
    best = (F.max if keep == "largest" else F.min)(F.struct("id", "n"))
    groups = counted.groupBy("hash", "variant").agg(best.alias("best"), F.sum("n").alias("group_size"))
    return counted, groups.select(
        "hash", "variant", F.col("best.id").alias("keep_id"), F.col("best.n").alias("n_keep"), "group_size",
    )


def _checked(keep: str) -> None:
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is smallest or largest, not {keep}")


def mark_copies(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, keep: str = "smallest",
    content_hash: Callable[[Column], Column] = md5_bytes,
) -> DataFrame:
    """One row per row of ``df``: id, id of the row that stays, group size, whether it stays, SHA-256 of the text."""
    _checked(keep)
    counted, groups = _groups(_hashed(df, doc_id, text, content_hash), keep)
    group = groups.select(F.col("hash").alias("_hash"), F.col("variant").alias("_variant"), "keep_id", "group_size")
    same = (F.col("hash") == F.col("_hash")) & F.col("variant").eqNullSafe(F.col("_variant"))
    copies = counted.join(group, same).select(
        "id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"), "sha",
    )
    stays = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return copies.select(
        F.col("id").alias(doc_id), "keep_id", F.col("group_size").cast("long"), stays.alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, keep: str = "smallest",
    content_hash: Callable[[Column], Column] = md5_bytes,
) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    Of repeated rows with the id that stays, the one whose columns are smallest as JSON is taken.
    """
    _checked(keep)
    _, groups = _groups(_hashed(df, doc_id, text, content_hash), keep)
    stays = written(groups, "groups")
    # The caller's columns travel as one struct, so that none can clash with the names used here.
    rows = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("row"), content_hash(_text(text)).alias("hash_of_row"))
    id_, whole = F.col("row")[doc_id], F.coalesce(F.col("row")[text], F.lit(""))

    def joined(side: DataFrame) -> DataFrame:
        same = (F.col("hash_of_row") == F.col("hash")) & id_.eqNullSafe(F.col("keep_id")) & (
            F.col("variant").isNull() | (F.col("variant") == whole))
        return rows.join(side, same)

    single = joined(stays.where("n_keep = 1")).select("row.*")
    several = stays.where("n_keep > 1")
    if several.isEmpty():  # saves a second shuffle of the texts
        return single
    tied = joined(several).groupBy("hash", "variant")
    return single.unionByName(tied.agg(F.min_by("row", F.to_json("row")).alias("row")).select("row.*"))
