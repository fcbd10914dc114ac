import os
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(120_000))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package(spark):
    spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def odd_docs(spark, tmp_path_factory):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and clashing extra columns."""
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\r\x0b\x0c ", None, None), (4, "one", "en", None), (5, "One two", None, "a"),
        (6, "one two three four", "en", "a"), (6, "one two three four", "en", "a"), (7, "ONE two three four", "en", "b"),
        (8, LONG, "en", "a"), (9, LONG, "de", "b"), (None, "one two three four", "en", "a"), (None, None, None, None),
        (10, "naïve café | x # y\n\nsame line\nsame line\n" * 30, "fr", "c"), (11, "퟿\U0001f600 emoji <|endoftext|> a  b   c ", "fr", "c"),
        (12, "x" * 50_000, "en", "c"), (12, "another text under the same id", "en", "c"),
    ]
    frame = spark.createDataFrame([(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows], DOCS)
    names = ["score", "kept", "fp", "shard", "slot", "epoch", "id", "hash", "n", "chunk", "learn", "label", "html", "block", "tokens", "Stats",
             "KEEP_ID", "measure", "bucket", "level", "rows", "fence", "component_id", "sequence_id", "block_key", "order_key",
             "_row", "_source", "_key", "_blocks", "rest", "epochs", "cut_key", "cut_block", "cut_order", "_content_hash", "_hash", "_part", "_place",
             "_range", "_bytes", "_fp", "_stays", "node", "root", "hash_of_row", "variant", "sha", "copy", "row", "tied", "runs", "collapsed", "word", "largest"]
    path = str(tmp_path_factory.mktemp("odd") / "documents.parquet")
    frame = frame.withColumn("a map", F.create_map(F.lit("k"), F.col("doc_id")))
    frame.withColumns({name: F.lit(None).cast("string") if i % 2 else F.lit("x") for i, name in enumerate(names)}).write.parquet(path)
    return spark.read.parquet(path)


def values_of(frame, columns=None):
    """The rows of a frame, with all values of the named columns, to be counted."""
    names = [c for c in (columns or frame.columns)]
    return Counter(str([(c, r[c]) for c in names]) for r in frame.collect())


@pytest.fixture(scope="session")
def no_docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("none") / "documents.parquet")
    spark.createDataFrame([], DOCS).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
