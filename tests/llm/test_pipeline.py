"""The stages of the corpus pipeline, each against brute force on what it was given."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from portfold.llm import mixing, quality_rules, simhash
from tests.conftest import SMALL
from tests.llm.test_near_duplicates import classes_by_hand, fingerprint_by_hand


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage was given and returned, written between them."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, SMALL).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_order_and_columns(stages):
    assert list(stages) == ["quality_rules", "exact_dedup", "simhash_near_dedup", "mixing", "packing"]
    for name in list(stages)[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns


def test_rules_keep_what_the_operator_keeps(stages):
    before, after = stages["quality_rules"]
    kept = {r["doc_id"] for r in quality_rules.apply_rules(before).where("kept").collect()}
    assert Counter(r["doc_id"] for r in after.collect()) == Counter(kept)
    assert 0 < len(kept) < before.count()


def test_largest_copy_stays(stages):
    before, after = stages["exact_dedup"]
    stays = defaultdict(int)
    for r in before.collect():
        stays[r["text"]] = max(stays[r["text"]], r["doc_id"])
    assert {(r["text"], r["doc_id"]) for r in after.collect()} == set(stays.items()) and after.count() == len(stays)


def test_smallest_near_copy_stays(stages):
    before, after = stages["simhash_near_dedup"]
    rows = sorted(before.collect(), key=lambda r: r["doc_id"])
    roots = classes_by_hand([fingerprint_by_hand(r["text"]) for r in rows])
    assert Counter(rows[root]["text"] for root in set(roots)) == Counter(r["text"] for r in after.collect())
    assert sorted(r["doc_id"] for r in after.collect()) == sorted({rows[root]["doc_id"] for root in roots})
    assert simhash.near_duplicates(after).select("component_id").distinct().count() == after.count()


def test_mixing_meets_its_plan(stages):
    before, after = stages["mixing"]
    plan = {r["_source"][1:]: r for r in mixing.plan(before, entropy_share=0.95, max_repeat=2.0, seed=5).collect()}
    tokens, longest = Counter(), Counter()
    for r in after.collect():
        tokens[r["source"]] += len(r["text"].split())
    for r in before.collect():
        longest[r["source"]] = max(longest[r["source"]], len(r["text"].split()))
    for source, r in plan.items():
        assert r["target"] - longest[source] < tokens[source] <= r["target"]
    assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in before.collect()}


def test_packing_takes_every_row(stages):
    before, after = stages["packing"]
    pieces = after.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("tokens")).collect()
    times = Counter(r["doc_id"] for r in before.collect())
    assert {r["doc_id"]: r["n"] // r["tokens"] for r in pieces} == times
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_run_gives_the_rows_of_the_stages(spark, stages):
    result = corpus_pipeline.run(spark, SMALL)
    expected = stages["packing"][1]
    assert result.columns == expected.columns
    total = [F.count("*"), F.sum("length"), F.countDistinct("doc_id")]
    assert result.agg(*total[1:]).first() == expected.agg(*total[1:]).first()


def test_stages_take_empty_and_odd_tables(spark, no_docs, odd_docs):
    for docs in (no_docs, odd_docs):
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SMALL)
            if name == "packing":
                assert after.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
            else:
                assert after.count() <= 2 * docs.count() and after.columns == docs.columns
