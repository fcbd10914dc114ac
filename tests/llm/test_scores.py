"""Quality classifier (1) and language-model scores (3)."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from portfold.llm import lm_scoring, quality_classifier, queries
from portfold.llm.support import remainder_of_id
from tests.conftest import SMALL

ORDER = lm_scoring.ORDER


def auc(good, bad):
    good, bad = np.array(good)[:, None], np.array(bad)[None]
    return (good > bad).mean() + 0.5 * (good == bad).mean()


def test_held_out_quality(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    scored = quality_classifier.score_documents(docs, labels, remainder_of_id(F.col("id"), 4) != 2, seed=1)
    held = scored.where(remainder_of_id(F.col("doc_id"), 4) == 2).join(labels, "doc_id").collect()
    assert scored.count() == docs.count()
    assert auc([r["score"] for r in held if r["quality"] == 1], [r["score"] for r in held if r["quality"] == 0]) > 0.97
    assert np.mean([(r["score"] >= 0.7) == (r["quality"] == 1) for r in held]) > 0.95


def test_statistics_see_the_whole_text_and_only_the_text():
    base = "a b c d " * 20_000
    assert quality_classifier.statistics(base.encode()) != quality_classifier.statistics((base + "### $$$").encode())
    for text in (b"", b" ", b"\n\n", b"x", "é".encode(), b"a" * 10**6):
        stats = quality_classifier.statistics(text)
        assert len(stats) == quality_classifier.STATISTICS and all(map(math.isfinite, stats))


def test_normal_equations_add_up(spark):
    """Summed per partition and fold, they are those of all rows at once."""
    rng = np.random.default_rng(2)
    stats = rng.normal(size=(400, quality_classifier.STATISTICS))
    y = (stats[:, 0] > 0).astype(float)
    rows = [(s.tolist(), float(v), i % 4) for i, (s, v) in enumerate(zip(stats, y, strict=True))]
    frame = spark.createDataFrame(rows, "stats array<double>, label double, fold int").repartition(7)
    directions, phases = rng.normal(size=(quality_classifier.STATISTICS, 30)), rng.uniform(0, 6, 30)
    model = quality_classifier.Model(stats.mean(axis=0), stats.std(axis=0), directions, phases)
    sums = quality_classifier._normal_equations(frame, model)
    z = model.features(stats)
    assert sorted(sums) == [0, 1, 2, 3]
    assert np.allclose(sum(sums.values()), z.T @ np.hstack([z, y[:, None]]))


def test_features_approximate_the_kernel():
    rng = np.random.default_rng(3)
    n = quality_classifier.STATISTICS
    model = quality_classifier.Model(
        np.zeros(n), np.ones(n), rng.normal(0, 1 / math.sqrt(n), (n, 20_000)), rng.uniform(0, 2 * math.pi, 20_000))
    a, b = rng.normal(size=(1, n)), rng.normal(size=(1, n))
    kernel = math.exp(-((a - b) ** 2).sum() / (2 * n))
    assert abs((model.features(a)[:, :-1] @ model.features(b)[:, :-1].T).item() - kernel) < 0.03


def test_isotonic_is_the_best_rising_fit():
    rng = np.random.default_rng(4)
    x, y, w = np.arange(60.0), rng.random(60) + np.arange(60) / 60, rng.integers(1, 5, 60).astype(float)
    centres, values = quality_classifier.isotonic(x, y, w)
    assert (np.diff(values) > 0).all() and (np.diff(centres) > 0).all()
    # min-max formula of isotonic regression
    best = [max(min((y[i:j] @ w[i:j]) / w[i:j].sum() for j in range(k + 1, 61)) for i in range(k + 1)) for k in range(60)]
    assert {round(v, 9) for v in values} == {round(v, 9) for v in best}


def test_quality_of_odd_texts(spark, odd_docs, no_docs, small_docs):
    labels = spark.createDataFrame(
        [(1, 1), (4, 0), (6, 1), (6, 0), (8, 1), (10, 0), (None, 1), (2, None), (777, 1)], "doc_id long, quality int")
    got = quality_classifier.score_documents(odd_docs, labels)
    assert got.columns == ["doc_id", "score"]
    assert Counter(r["doc_id"] for r in got.collect()) == Counter(r["doc_id"] for r in odd_docs.collect())
    assert all(0 <= r["score"] <= 1 for r in got.collect())
    unlabelled = quality_classifier.score_documents(small_docs, labels.where("quality > 5"))
    assert {r["score"] for r in unlabelled.collect()} == {0.5}
    one_class = quality_classifier.score_documents(small_docs, labels.where("quality = 1"))
    assert all(0 <= r["score"] <= 1 for r in one_class.collect())
    assert quality_classifier.score_documents(no_docs, labels).count() == 0


class Trie:
    """Prediction by partial matching, byte by byte."""

    def __init__(self, texts):
        self.after = {}
        for text in texts:
            symbols = self.symbols(text)
            for p in range(ORDER, len(symbols)):
                for k in range(ORDER + 1):
                    self.after.setdefault(symbols[p - k:p], Counter())[symbols[p]] += 1

    @staticmethod
    def symbols(text):
        return b"\xff" * ORDER + text + b"\xfe"

    def log(self, text):
        symbols = self.symbols(text)
        return sum(self.log_of(symbols[p - ORDER:p], symbols[p]) for p in range(ORDER, len(symbols)))

    def log_of(self, context, symbol):
        total, gone = 0.0, set()
        for k in range(ORDER, -1, -1):
            left = {s: c for s, c in self.after.get(context[ORDER - k:], {}).items() if s not in gone}
            if symbol in left:
                return total + math.log10((left[symbol] - 0.5) / sum(left.values()))
            if left:
                total += math.log10(len(left) / (2 * sum(left.values())))
                gone |= set(left)
        return total - math.log10(255 - len(gone))


def by_hand(rows, learn):
    texts = [(r["text"] or "").encode() for r in rows]
    trie = Trie([t for t, l in zip(texts, learn, strict=True) if l])
    count = Counter(w for t, l in zip(texts, learn, strict=True) if l for w in [*t.lower().split(), b" "])
    n, v = sum(count.values()), len(count)
    for r, text, l in zip(rows, texts, learn, strict=True):
        own = [*text.lower().split(), b" "]
        base = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own) if n else 0.0
        yield r["doc_id"], l, len(own), sum(count[w] > 0 for w in own), n, base, trie.log(text)


def same(got, expected):
    key = lambda r: (r[0] is None, r[0] or 0, *[round(x, 4) for x in r[2:]])
    got, expected = sorted((tuple(r) for r in got), key=key), sorted(expected, key=key)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-6)


def test_scores_by_hand(small_docs):
    learn = remainder_of_id(F.col("doc_id"), 10) != 0
    rows = small_docs.withColumn("l", learn).where("n_chars < 1500").limit(60).collect()
    ids = [r["doc_id"] for r in rows]
    frame = small_docs.where(F.col("doc_id").isin(ids))
    same(lm_scoring.score_texts(frame, learn).collect(), by_hand(rows, [r["l"] for r in rows]))


def test_scores_of_odd_texts(odd_docs, no_docs):
    short = odd_docs.where("n_chars < 5000 or n_chars is null")
    for learn in (F.col("doc_id") != 7, F.lit(False), F.lit(True)):
        rows = short.withColumn("_l", F.coalesce(learn, F.lit(False))).select("doc_id", "text", "_l").collect()
        same(lm_scoring.score_texts(short, learn).collect(), by_hand(rows, [r["_l"] for r in rows]))
    assert lm_scoring.score_texts(odd_docs, F.lit(True)).count() == odd_docs.count()
    assert lm_scoring.score_texts(no_docs, F.lit(True)).count() == 0


def test_probabilities_add_up():
    """Over all symbols, for seen and unseen contexts: the gram buckets give a proper distribution."""
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 100, 40).astype(np.uint8)) for _ in range(5)]
    codes = np.concatenate([c for c, _ in lm_scoring._pieces(texts)])
    contexts = np.unique(np.r_[codes >> 8, [0x7A7A7A7A7A, 0x6161617A61]])
    grams = np.unique((contexts[:, None] << 8 | np.arange(255)).ravel())
    counts = np.zeros(len(grams), np.int64)
    np.add.at(counts, np.searchsorted(grams, codes), 1)
    pairs = np.bincount(codes & 0xFFFF, minlength=1 << 16).reshape(256, 256)
    parts = lm_scoring._gram_buckets(grams, 7)
    for bucket in np.unique(parts):
        own = parts == bucket
        logs = lm_scoring.code_lengths(grams[own], counts[own], pairs)
        assert np.allclose(np.exp(logs).reshape(-1, 255).sum(axis=1), 1)


def test_long_texts_in_pieces(monkeypatch):
    text = bytes(np.random.default_rng(6).integers(97, 123, 1000).astype(np.uint8))
    whole = np.concatenate([c for c, _ in lm_scoring._pieces([b"", text, b"x"])])
    for size in (7, 64, 1000, 1001):
        monkeypatch.setattr(lm_scoring, "_PIECE", size)
        parts = list(lm_scoring._pieces([b"", text, b"x"]))
        assert (np.concatenate([c for c, _ in parts]) == whole).all()
        assert np.bincount(np.concatenate([t for _, t in parts])).tolist() == [1, 1001, 2]


def test_chunks_are_cut_by_the_bytes_of_their_texts(spark, monkeypatch, tmp_path):
    """Also where most texts are equal, which files hold once, and where a frame is not read from files."""
    rows = [(i, "the same long text " * 100 if i % 3 else f"own text {i} " * 50) for i in range(1500)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 100_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200k")
    try:
        for frame in (spark.read.parquet(str(tmp_path / "d")), spark.createDataFrame(rows, "doc_id long, text string")):
            chunked, size = lm_scoring._chunked(frame, "doc_id", "text")
            sums = [r[1] for r in chunked.groupBy("chunk").agg(F.sum(F.octet_length("text"))).collect()]
            assert sum(sums) == size == sum(len(t) for _, t in rows) and max(sums) < 2 * 100_000 and len(sums) >= size // 200_000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_quality_query_by_one_numpy_pass(spark):
    """The registered query against the same features, normal equations and calibration over all rows at once."""
    q = quality_classifier
    rows = queries.op1_quality_classifier(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    label_of = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    parts = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(q.FOLDS)).alias("fold")).collect()
    stats = np.array([q.statistics((r["text"] or "").encode()) for r in parts])
    learn = np.array([r["doc_id"] in label_of and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 for r in parts])
    x, fold = stats[learn], np.array([r["fold"] for r in parts])[learn]
    y = np.array([label_of[r["doc_id"]] for r, k in zip(parts, learn, strict=True) if k], dtype=float)
    rng = np.random.default_rng(1)
    directions = rng.normal(0, 1 / math.sqrt(q.STATISTICS), (q.STATISTICS, q.FEATURES))
    phases = rng.uniform(0, 2 * math.pi, q.FEATURES)
    spread = x.std(axis=0)
    model = q.Model(x.mean(axis=0), np.where(spread > 1e-9, spread, 1.0), directions, phases)

    def ridge(z, target):
        return np.linalg.solve(z.T @ z + np.eye(z.shape[1]) * q.RIDGE * max(1.0, len(z)), z.T @ target)
    z = model.features(x)
    raw = np.zeros(len(x))
    for f in range(q.FOLDS):
        raw[fold == f] = z[fold == f] @ ridge(z[fold != f], y[fold != f])
    at = np.clip(((raw + 0.5) / 2 * q.BINS).astype(int), 0, q.BINS - 1)
    used = np.unique(at)
    mean = np.array([y[at == b].mean() for b in used])
    model.weights = ridge(z, y)
    model.knots, model.values = q.isotonic(-0.5 + (used + 0.5) * 2 / q.BINS, mean, np.array([(at == b).sum() for b in used], dtype=float))
    expected = dict(zip([r["doc_id"] for r in parts], model.score(stats), strict=True))
    assert len(rows) == len(parts)
    for r in rows:
        assert r["score"] == pytest.approx(expected[r["doc_id"]], abs=1e-6) and r["predicted"] == (r["score"] >= 0.7)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
