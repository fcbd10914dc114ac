"""Temperature mixing (5) and exact-size shards (6)."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from portfold.llm import mixing, sharding
from tests.llm.conftest import values_of


@pytest.fixture(scope="module")
def uneven(spark, tmp_path_factory):
    rows = [(i, f"word{i} " * (1 + i % 7), "hot" if i % 3 else f"s{i % 5}" if i % 2 else None) for i in range(3000)]
    path = str(tmp_path_factory.mktemp("uneven") / "docs.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(path)
    return spark.read.parquet(path)


def tokens_by_source(rows):
    total = Counter()
    for r in rows:
        total[r["source"]] += len((r["text"] or "").split())
    return total


def entropy_of(weights):
    return -sum(w * math.log(w) for w in weights if w > 0)


@pytest.mark.parametrize("share", [0.7, 0.9, 0.99])
def test_weights_by_bisection(uneven, share):
    total = tokens_by_source(uneven.collect())
    p = np.array([n / sum(total.values()) for n in total.values()])

    def weights(a):
        return p**a / (p**a).sum()
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if entropy_of(weights(mid)) >= share * math.log(len(p)) else (low, mid)
    found = {r["_source"]: r["weight"] for r in mixing.plan(uneven, entropy_share=share, max_repeat=None).collect()}
    expected = dict(zip(total, weights(low), strict=True))
    assert sorted(found.values()) == pytest.approx(sorted(expected.values()), abs=1e-4)
    assert entropy_of(found.values()) >= share * math.log(len(p)) - 1e-9


def test_repetition_limit_goes_first(uneven):
    total = tokens_by_source(uneven.collect())
    plan = mixing.plan(uneven, entropy_share=1.0, max_repeat=1.5).collect()
    assert max(r["target"] / r["tokens"] for r in plan) <= 1.5
    assert max(r["target"] / r["tokens"] for r in plan) > 1.49  # no further from the wish than needed
    assert sum(r["tokens"] for r in plan) == sum(total.values())
    with pytest.raises(ValueError):
        mixing.plan(uneven, budget=10 * sum(total.values()), max_repeat=2.0)


@pytest.mark.parametrize("budget_share", [0.3, 1.0, 1.9])
def test_budget_is_met_from_below(uneven, budget_share, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 64)
    rows = uneven.collect()
    budget = int(budget_share * sum(tokens_by_source(rows).values()))
    plan = {r["_source"]: r for r in mixing.plan(uneven, budget=budget, max_repeat=4.0, seed=9).collect()}
    mixed = mixing.mix(uneven, budget=budget, max_repeat=4.0, seed=9).collect()
    taken = tokens_by_source(mixed)
    times = defaultdict(set)
    for r in mixed:
        assert r["epoch"] not in times[r["doc_id"]]
        times[r["doc_id"]].add(r["epoch"])
    for r in rows:
        key = "null" if r["source"] is None else "=" + r["source"]
        epochs = plan[key]["epochs"]
        assert times[r["doc_id"]] in (set(range(epochs)), set(range(epochs + 1)))
    for key, r in plan.items():
        got = taken[None if key == "null" else key[1:]]
        assert r["target"] - 7 <= got <= r["target"]  # the next document has at most seven words
    assert abs(sum(r["target"] for r in plan.values()) - budget) <= len(plan)


def test_the_last_epoch_is_a_prefix_of_its_permutation(uneven, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 64)
    half = mixing.mix(uneven, budget=4000, max_repeat=None, entropy_share=None, seed=1).collect()
    whole = mixing.mix(uneven, max_repeat=None, entropy_share=None, seed=1).collect()
    assert len(whole) == uneven.count() and {r["epoch"] for r in whole} == {0}
    order = defaultdict(list)
    for r in sorted(whole, key=lambda r: (r["block_key"], r["order_key"])):
        order[r["source"]].append(r["doc_id"])
    taken = defaultdict(set)
    for r in half:
        taken[r["source"]].add(r["doc_id"])
    for source, ids in taken.items():
        assert ids == set(order[source][:len(ids)])
    blocks = [r["block_key"] for r in sorted(whole, key=lambda r: (r["block_key"], r["order_key"]))]
    assert len(set(blocks)) > 30


def test_blocks_in_ranges_are_cut_at_the_same_place(uneven, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 16)
    cuts = []
    for blocks in (65_536, 3):
        monkeypatch.setattr(mixing, "RANGE_BLOCKS", blocks)
        plan = mixing.plan(uneven, budget=5000, max_repeat=None, entropy_share=0.9, seed=4).collect()
        cuts.append({r["_source"]: (r["cut_key"], r["cut_block"], r["cut_order"], r["target"]) for r in plan})
    assert cuts[0] == cuts[1] and len(cuts[0]) > 2


def test_mix_of_odd_rows(odd_docs, no_docs):
    mixed = mixing.mix(odd_docs, seed=2)
    assert [c for c in mixed.columns if c not in mixing.RESULT] == [c for c in odd_docs.columns if c.lower() not in mixing.RESULT]
    assert mixed.count() > 0
    natural = mixing.mix(odd_docs, entropy_share=None, max_repeat=None)
    own = [c for c in odd_docs.columns if c.lower() not in mixing.RESULT]
    assert values_of(natural, own) == values_of(odd_docs, own)
    assert set(values_of(mixed, own)) <= set(values_of(odd_docs, own))
    assert mixing.mix(no_docs).count() == 0


def test_shards_are_exact_and_gapless(small_docs, odd_docs, no_docs):
    for frame, shards in ((small_docs, 40), (small_docs.repartition(13), 7), (odd_docs, 40)):
        rows = sharding.shuffle_into_shards(sharding.document_sizes(frame), shards, seed=3).collect()
        by = defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r["slot"])
        assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in frame.collect())
        sizes = [len(by[j]) for j in range(shards)]
        assert max(sizes) - min(sizes) <= 1 and set(by) <= set(range(shards))
        assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    assert sharding.shuffle_into_shards(sharding.document_sizes(no_docs)).count() == 0


def test_slots_in_ranges(small_docs, monkeypatch):
    monkeypatch.setattr(sharding, "RANGE_ROWS", 4)
    rows = sharding.shuffle_into_shards(sharding.document_sizes(small_docs), 5).collect()
    for j in range(5):
        assert sorted(r["slot"] for r in rows if r["shard"] == j) == list(range(40))


def test_sizes_and_checksums(odd_docs):
    got = Counter(tuple(r) for r in sharding.document_sizes(odd_docs).collect())
    text = lambda r: (r["text"] or "").encode()
    assert got == Counter((r["doc_id"], len(text(r)) + 16, zlib.crc32(text(r))) for r in odd_docs.collect())


def test_shards_keep_columns(odd_docs):
    dealt = sharding.shuffle_into_shards(odd_docs, 3)
    assert dealt.columns == [*[c for c in odd_docs.columns if c not in ("shard", "slot")], "shard", "slot"]
    own = [c for c in odd_docs.columns if c not in ("shard", "slot")]
    assert values_of(dealt, own) == values_of(odd_docs, own)


@pytest.mark.parametrize(("good", "bad", "drawn"), [(40, 60, 30), (60, 40, 30), (40, 60, 80), (3, 500, 400), (500, 3, 100), (1, 1, 1)])
def test_rejection_draws_by_the_exact_law(good, bad, drawn):
    rng = np.random.default_rng(good + drawn)
    seen = Counter(sharding.by_rejection(rng, good, bad, drawn) for _ in range(20_000))
    law = {k: math.comb(good, k) * math.comb(bad, drawn - k) / math.comb(good + bad, drawn) for k in range(max(0, drawn - bad), min(good, drawn) + 1)}
    assert set(seen) <= set(law)
    chi = sum((seen[k] - 20_000 * p) ** 2 / (20_000 * p) for k, p in law.items() if 20_000 * p >= 5)
    assert chi < 3 * sum(20_000 * p >= 5 for p in law.values()) + 15


def test_urns_beyond_a_billion_rows():
    rng = np.random.default_rng(1)
    good, bad, drawn = 3 * 10**10, 9 * 10**10, 10**9
    draws = np.array([sharding._hypergeometric(rng, good, bad, drawn) for _ in range(4000)], dtype=float)
    spread = math.sqrt(drawn * 0.25 * 0.75 * (1 - drawn / 12e10))
    assert abs(draws.mean() - drawn / 4) < 4 * spread / math.sqrt(4000) and abs(draws.std() / spread - 1) < 0.05
    sent = sharding.communication_matrix([10**9 + 1, 0, 2 * 10**10], 7, rng)
    assert sent.sum(axis=1).tolist() == [10**9 + 1, 0, 2 * 10**10] and np.ptp(sent.sum(axis=0)) <= 1
    assert sharding._hypergeometric(rng, 10**10, 0, 5) == 5 and sharding._hypergeometric(rng, 0, 10**10, 5) == 0


def test_matrix_sums_and_law():
    rng = np.random.default_rng(0)
    rows = [5, 0, 17, 3, 100]
    drawn = [sharding.communication_matrix(rows, 4, rng) for _ in range(4000)]
    for sent in drawn[:50]:
        assert sent.sum(axis=1).tolist() == rows
        assert max(sent.sum(axis=0)) - min(sent.sum(axis=0)) <= 1
    # Row of 5 out of 125 over four shards of 31 or 32: mean 1.25 each, hypergeometric variance.
    first = np.array([s[0, 0] for s in drawn])
    assert abs(first.mean() - 1.25) < 0.06
    assert abs(first.var() - 5 * 0.25 * 0.75 * 120 / 124) < 0.08


def test_every_place_is_alike(spark):
    """Of 24 rows in 3 partitions, each row falls into each of 4 shards about as often."""
    frame = spark.range(0, 24, 1, 3)
    seen = np.zeros((24, 4))
    for seed in range(40):
        for r in sharding.shuffle_into_shards(frame, 4, seed=seed).collect():
            seen[r["id"], r["shard"]] += 1
    assert (seen.sum(axis=1) == 40).all()
    chi = ((seen - 10) ** 2 / 10).sum()
    assert chi < 130  # 72 degrees of freedom


def test_written_shards_read_back_in_order(small_docs, spark, tmp_path):
    dealt = sharding.shuffle_into_shards(small_docs.select("doc_id", "text"), 4)
    sharding.write_shards(dealt, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == small_docs.count()
    assert back.groupBy("shard").agg(F.max("slot").alias("m")).where("m <> 49").count() == 0
