"""From raw documents to packed training sequences: rules, exact and near deduplication, mixing, packing.

Every stage takes all rows that the one before returned, and all but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from portfold.llm import exact_dedup, mixing, packing, quality_rules, simhash
from portfold.llm.queries import vocabulary
from portfold.llm.support import read, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the adaptive rules keep."""
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest id."""
    return exact_dedup.drop_copies(docs, keep="largest")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (three-word shingles, two bits): the one with the smallest id."""
    return simhash.drop_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as there are, dealt to the sources by temperature, in the order of the block permutation."""
    mixed = mixing.mix(docs, entropy_share=0.95, max_repeat=2.0, seed=5)
    return mixing.in_order(mixed).select(*[f"`{c}`" for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality_rules", rules), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixing", mix), ("packing", pack)]

# No SQL: fingerprints need XXH64 and packing a tokenizer. The tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared scratch folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
