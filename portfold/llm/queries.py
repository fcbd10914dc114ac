"""The registered queries of this package, each over the whole of its table, with production parameters."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from portfold.llm import (
    exact_dedup, html_extraction, license_scan, lm_scoring, mixing, packing, periodic_runs, quality_classifier,
    quality_rules, sharding, simhash, spelling_variants, warc,
)
from portfold.llm.support import let, read, remainder_of_id, words
from portfold.sources.scratch import scratch_path


def vocabulary() -> str:
    """The tokenizer file of the installed vocabularies, at the same place on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = quality_classifier.score_documents(docs, labels, remainder_of_id(F.col("id"), 4) != 2, seed=1)
    held_out = remainder_of_id(F.col("doc_id"), 4) == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = lm_scoring.score_texts(docs, remainder_of_id(F.col("doc_id"), 10) != 0)
    return scored.withColumn("learn", ~F.col("learn")).withColumnRenamed("learn", "held_out")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(read(spark, sf_dir, "documents"), keep="largest")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, entropy_share=0.95, max_repeat=2.0, seed=5).drop("text")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = sharding.document_sizes(read(spark, sf_dir, "documents"))
    dealt = sharding.shuffle_into_shards(sizes, 40, seed=20)
    return dealt.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_documents(read(spark, sf_dir, "documents"), seed=3)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary())


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(read(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, folder = read(spark, sf_dir, "pages"), scratch_path(spark, "warc")
    warc.archive(pages, folder, date="2026-01-01T00:00:00Z")
    records = warc.archived_pages(spark, folder, pages.schema["page_id"].dataType)
    return records.withColumnRenamed("key", "page_id")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """Id and text, of which a tenth, by the CRC-32 of the id, repeats a stretch of its own words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(parts: Column) -> Column:
        n = F.size(parts)
        start = F.pmod(g, n)
        period = 1 + F.floor((n - start) / (3 + F.pmod(g, F.lit(8))))
        return let(F.struct(start.cast("int").alias("a"), period.cast("int").alias("p")), lambda at: F.array_join(
            F.transform(parts, lambda w, i: F.when(i < at["a"], w).otherwise(F.get(parts, at["a"] + F.pmod(i - at["a"], at["p"])))), " "))

    planted = let(words(F.col("text")), lambda parts: F.when(F.size(parts) > 0, repeated(parts)).otherwise(""))
    return docs.select("doc_id", F.when(F.pmod(h, F.lit(10)) == 0, planted).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.find_runs(with_planted_runs(read(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    best = found.withColumn("best", periodic_runs.longest(F.col("runs")))
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def spelled_words(docs: DataFrame) -> DataFrame:
    """Every word of every text, one of 97 occurrences, by the CRC-32 of id and word, without one of its letters."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(spelling_variants.runs_of_letters(F.col("text"))).alias("run"))
    # What is too short with all its letters is too short without one.
    rows = rows.where(F.char_length("run") >= 5).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.char_length("run")).cast("int")
    shorter = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    return rows.select(F.when(F.pmod("h", F.lit(97)) == 0, shorter).otherwise(F.col("run")).alias("word"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    occurrences = spelled_words(read(spark, sf_dir, "documents"))
    return spelling_variants.group_variants(spelling_variants.counted_words(occurrences, least_length=5, least_count=3))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_quality_classifier, op2_quality_rules, op3_lm_scoring, op4_exact_dedup, op5_mixing, op6_sharding,
        op7_license_scan, op8_packing, op9_html_extraction, op10_simhash, op11_warc, op12_periodic_runs, op13_spelling_variants,
    )
}
