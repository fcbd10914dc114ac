"""Quality scores by a kernel ridge classifier over document statistics, calibrated by isotonic regression.

Every whole text becomes a short vector of statistics (lengths, repetition, shares of character classes, entropy).
Random Fourier features approximate a Gaussian kernel over the standardised vectors. The ridge scores come from normal
equations that each partition sums up for itself, per fold; the sums are added in two rounds of streams, so a task
holds one sum however many partitions there are, and the driver gets one matrix per fold. As the sums of the folds add
up, every fold's rows are scored by a model of the other folds; those scores, counted in ``BINS`` bins, are fitted by isotonic
regression to probabilities.

Statistics are computed once per text and written to the scratch folder. All labelled rows are used.

Defined results: null text counts as empty; every row gets a score, empty texts too; label rows with a null id or label are
ignored, several labels of an id are averaged; rows with a null id are scored but never learned from; without any label each
score is 0.5; an empty table gives an empty result; other columns of the input are ignored, whatever their names.
"""

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portfold.llm.support import written

FEATURES = 192
FOLDS = 4
RIDGE = 1e-4
BINS = 4000
_LANES = 64
_CLIP = 5.0
_RAW_SHARE = 0.01


def _class(characters: bytes) -> np.ndarray:
    mask = np.zeros(256)
    mask[list(characters)] = 1
    return mask


_CLASSES = np.stack([
    _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789"), _class(b" \t\n\x0b\x0c\r"),
    _class(b".,;:'\"()-"), _class(b"#*$%&|<>"), _class(b"!?~^_=+{}[]\\@/"), _class(bytes(range(128, 256))), _class(b"."),
])
STATISTICS = 19


def statistics(text: bytes) -> list[float]:
    """The statistics of a whole UTF-8 text; all finite, all zero for an empty one."""
    if not text:
        return [0.0] * STATISTICS
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digits, _, marks, symbols, loud, other, stops = (_CLASSES @ counts).tolist()
    size = len(text)
    share = counts[counts > 0] / size
    parts = text.split()
    n = max(1, len(parts))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) if parts else np.zeros(1, np.int64)
    tally = Counter(parts)
    lines = [line for line in text.split(b"\n") if line.strip()]
    pairs = len(set(zip(parts, parts[1:], strict=False)))
    return [
        math.log1p(size), math.log1p(len(parts)), float(lengths.mean()), float(lengths.std()), math.log1p(float(lengths.max())),
        len(tally) / n, math.log1p(len(tally)) / math.log1p(n), pairs / max(1, n - 1), max(tally.values(), default=0) / n,
        upper / max(1.0, upper + lower), digits / size, symbols / n, loud / n, other / size, marks / n, stops / n,
        1 - len(set(lines)) / max(1, len(lines)), math.log1p(size / max(1, len(lines))), float(-(share * np.log2(share)).sum()),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [statistics(text or b"") for text in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "stats"])


def with_statistics(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    slim = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    fields = [slim.schema["id"], T.StructField("stats", T.ArrayType(T.DoubleType()))]
    return slim.mapInArrow(_statistics, T.StructType(fields))


@dataclass
class Model:
    """What turns statistics into scores; a few hundred kilobytes, whatever it was learned from."""

    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray | None = None
    values: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.centre) / self.scale, -_CLIP, _CLIP)
        z = np.cos(x @ self.directions + self.phases) * math.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Probabilities; within a flat step of the calibration a small share of the raw score keeps the order."""
        if self.weights is None or self.knots is None:
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        return np.clip((1 - _RAW_SHARE) * np.interp(raw, self.knots, self.values) + _RAW_SHARE * np.clip(raw, 0, 1), 0, 1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=float).reshape(-1, STATISTICS)


def isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled neighbours for rising x: the mean x and the mean y of each block, y rising."""
    blocks: list[list[float]] = []  # weight, weighted x, weighted y
    for a, b, w in zip(x, y, weight, strict=True):
        blocks.append([w, w * a, w * b])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][0] >= blocks[-1][2] / blocks[-1][0]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last, strict=True)]
    pooled = np.array(blocks)
    return pooled[:, 1] / pooled[:, 0], pooled[:, 2] / pooled[:, 0]


def _summed(rows: DataFrame) -> DataFrame:
    """Adds up matrices (lane, fold, sums) per fold in one streaming pass over each partition."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for fold, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                part = np.frombuffer(blob)
                totals[fold] = totals[fold] + part if fold in totals else part
        for fold, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int32()), pa.array([fold], pa.int32()), pa.array([total.tobytes()])], names=["lane", "fold", "sums"])
    return rows.mapInArrow(task, "lane int, fold int, sums binary")


def _normal_equations(train: DataFrame, model: Model) -> dict[int, np.ndarray]:
    """Per fold the sums of z z' and z y, as one matrix with y's column last."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            z = model.features(_matrix(batch.column(0)))
            zy = np.hstack([z, batch.column(1).to_numpy(zero_copy_only=False)[:, None]])
            folds = batch.column(2).to_numpy(zero_copy_only=False)
            for fold in np.unique(folds):
                mine = folds == fold
                part = z[mine].T @ zy[mine]
                totals[int(fold)] = totals.get(int(fold), 0) + part
        lane = TaskContext.get().partitionId() % _LANES
        for fold, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lane], pa.int32()), pa.array([fold], pa.int32()), pa.array([total.tobytes()])], names=["lane", "fold", "sums"])

    parts = train.select("stats", "label", "fold").mapInArrow(task, "lane int, fold int, sums binary")
    total = _summed(_summed(parts.repartition(_LANES, "lane")).repartition(1))
    width = len(model.phases) + 1
    return {r["fold"]: np.frombuffer(r["sums"]).reshape(width, width + 1) for r in total.collect()}


def _ridge(sums: np.ndarray) -> np.ndarray:
    gram, right = sums[:, :-1], sums[:, -1]
    rows = gram[-1, -1]
    return np.linalg.solve(gram + np.eye(len(gram)) * (RIDGE * max(1.0, rows)), right)


def fit(train: DataFrame, *, seed: int = 0) -> Model:
    """A model of rows (``id``, ``stats``, ``label`` from 0 to 1)."""
    train = written(train.select(
        "stats", F.col("label").cast("double").alias("label"), F.pmod(F.xxhash64("id"), F.lit(FOLDS)).cast("int").alias("fold"),
    ), "labelled")
    # One row of means and deviations.
    moments = train.agg(F.count("*"), *[f(F.get("stats", F.lit(i))) for i in range(STATISTICS) for f in (F.avg, F.stddev_pop)]).first()
    rng = np.random.default_rng(seed)
    directions = rng.normal(0, 1 / math.sqrt(STATISTICS), (STATISTICS, FEATURES))
    phases = rng.uniform(0, 2 * math.pi, FEATURES)
    if not moments[0]:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), directions, phases)
    scale = np.array(moments[2::2], dtype=float)
    model = Model(np.array(moments[1::2], dtype=float), np.where(scale > 1e-9, scale, 1.0), directions, phases)
    sums = _normal_equations(train, model)
    whole = sum(sums.values())
    others = {fold: _ridge(whole - own if len(sums) > 1 else whole) for fold, own in sums.items()}
    low, high = -0.5, 1.5

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, y = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            z = model.features(_matrix(batch.column(0)))
            folds = batch.column(2).to_numpy(zero_copy_only=False)
            raw = np.zeros(len(z))
            for fold, weights in others.items():
                raw[folds == fold] = z[folds == fold] @ weights
            at = np.clip(((raw - low) / (high - low) * BINS).astype(int), 0, BINS - 1)
            n += np.bincount(at, minlength=BINS)
            y += np.bincount(at, weights=batch.column(1).to_numpy(zero_copy_only=False), minlength=BINS)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used]), pa.array(y[used])], names=["bin", "n", "y"])

    bins = train.mapInArrow(binned, "bin long, n double, y double").groupBy("bin").agg(F.sum("n"), F.sum("y"))
    found = np.array(sorted(tuple(r) for r in bins.collect()), dtype=float)  # BINS rows at most
    centre = low + (found[:, 0] + 0.5) * (high - low) / BINS
    model.weights = _ridge(whole)
    model.knots, model.values = isotonic(centre, found[:, 2] / found[:, 1], found[:, 1])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """``id`` and ``score`` of rows (``id``, ``stats``)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], names=["id", "score"])
    schema = T.StructType([stats.schema["id"], T.StructField("score", T.DoubleType())])
    return stats.select("id", "stats").mapInArrow(task, schema)


def score_documents(
    df: DataFrame, labels: DataFrame, learn: Column | None = None, *, doc_id: str = "doc_id", text: str = "text",
    label: str = "quality", seed: int = 0,
) -> DataFrame:
    """Id and ``score`` of every row of ``df``, learned from its labelled rows where ``learn``, a condition on ``id``, holds."""
    stats = written(with_statistics(df, doc_id, text), "statistics")
    known = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("id")).agg(
        F.avg(F.col(label).cast("double")).alias("label"))
    train = stats.where(learn if learn is not None else F.lit(True)).join(known, "id")
    return score(stats, fit(train, seed=seed)).withColumnRenamed("id", doc_id)
