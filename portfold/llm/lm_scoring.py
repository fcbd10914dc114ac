"""Language-model scores: prediction by partial matching over bytes, and a smoothed word model beside it.

The model is a trie of byte contexts up to ``ORDER`` bytes, learned from the training documents. A byte is predicted from the
longest context that was seen: with c occurrences of it among the T that followed, it gets (c - 1/2) / T; D different bytes leave
D / 2T to escape by, to the context shorter by a byte, where the bytes already ruled out are excluded from the counts (symbol
exclusion); below the empty context the remaining byte values are alike. An end symbol closes every text, so the
probabilities of all texts add up to one.

How it runs. The input is read in chunks: splits of the files, parted by a hash by the bytes of their texts. Every chunk lists its
distinct (``ORDER`` + 1)-grams and words with their training counts, as compressed arrays per bucket: requests, which grow with
the corpus. Grams are in one bucket if their contexts end in the same two bytes, so a bucket has all longer contexts
whole (the two lowest orders are one 256 x 256 table, and are sent along); words are by a hash. Each bucket adds up its requests
in a stream and then answers them in a stream: the code lengths of just the grams, and the counts of just the words, that
a chunk asked for. With these the chunk is scored. So the model is never held or broadcast whole: a task holds
one chunk and its answers, or one bucket's distinct entries, however large the corpus is; buckets are dealt to several tasks by chunk
when they answer. The number of buckets grows with the square root of the number of chunks, which bounds both the rows and
the size of a bucket.

Requests and bucket sums are written to the scratch folder; texts are shuffled once, to meet their answers.

Defined results: null and empty texts have the end token and the end symbol only; rows with a null id are no training rows
(the caller's condition decides); without training text every byte value is alike and the word score uses c = N = V = 0; repeated rows
are learned and scored each; an empty table gives an empty result; other input columns are ignored.
"""

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from portfold.llm.support import written

ORDER = 5
CHUNK_BYTES = 32 << 20
SMOOTHING = 0.1
_BEGIN, _END, _VALUES = 0xFF, 0xFE, 255  # neither byte occurs in UTF-8; _BEGIN is never predicted
_END_WORD = b" "  # no word has white space
_PIECE = 1 << 20
_PIECE_TEXTS = 1 << (62 - 8 * (ORDER + 1))  # so that a text's number and a gram share a long
_HELD_WORDS = 500_000
_HELD_GRAMS = 1_000_000
_TEXTS = 512
_ANSWER_CHUNKS = 256  # chunks that one task answers for a bucket
GRAMS, WORDS = 0, 1


# Grams of texts

def _pieces(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pieces of about ``_PIECE`` bytes: gram codes of all their positions, and the number of the text of each."""
    batch, first, size = [], 0, 0
    for i, text in enumerate(texts):
        if len(text) > _PIECE:
            if batch:
                yield _codes(batch, first)
            yield from ((codes, np.full(len(codes), i)) for codes in _long(text))
            batch, first, size = [], i + 1, 0
            continue
        batch.append(text)
        size += len(text) + ORDER + 1
        if size >= _PIECE or len(batch) == _PIECE_TEXTS:
            yield _codes(batch, first)
            batch, first, size = [], i + 1, 0
    if batch:
        yield _codes(batch, first)


def _grams(symbols: np.ndarray) -> np.ndarray:
    """The code of every ``ORDER`` + 1 neighbours."""
    codes, width = symbols, 1  # doubled while possible
    while 2 * width <= ORDER + 1:
        codes, width = codes[:-width] << 8 * width | codes[width:], 2 * width
    rest = ORDER + 1 - width
    return codes[:len(codes) - rest] << 8 * rest | codes[rest:] & ((1 << 8 * rest) - 1) if rest else codes


def _codes(texts: list[bytes], first: int) -> tuple[np.ndarray, np.ndarray]:
    pad, end = bytes([_BEGIN]) * ORDER, bytes([_END])
    codes = _grams(np.frombuffer(b"".join([pad + t + end for t in texts]), np.uint8).astype(np.int64))
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    text = np.repeat(np.arange(len(texts)), lengths)
    # Text i's grams start where its padding does: after i paddings and the texts before it.
    return codes[np.arange(len(text)) + ORDER * text], text + first


def _long(text: bytes) -> Iterator[np.ndarray]:
    for start in range(0, len(text) + 1, _PIECE):
        piece = text[max(0, start - ORDER):start + _PIECE]
        if start < ORDER:
            piece = bytes([_BEGIN]) * (ORDER - start) + piece
        if start + _PIECE > len(text):
            piece += bytes([_END])
        yield _grams(np.frombuffer(piece, np.uint8).astype(np.int64))


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def _packed(values: np.ndarray, *, rising: bool = False) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress((np.diff(values, prepend=values.dtype.type(0)) if rising else values).tobytes())


def _unpacked(blob: bytes, kind: type, *, rising: bool = False) -> np.ndarray:
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)
    return np.cumsum(values) if rising else values


def _packed_words(words: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def _unpacked_words(blob: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompress(blob).split(b"\n")


def _gram_buckets(grams: np.ndarray, buckets: int) -> np.ndarray:
    """By the last two bytes of the context."""
    return ((grams >> 8 & 0xFFFF) * 40503 >> 4) % buckets


class _Requests:
    """Distinct grams and words of a chunk with their training counts. A chunk may be listed in several goes."""

    def __init__(self) -> None:
        self.words: Counter[bytes] = Counter()
        self.seen: set[bytes] = set()
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_grams = 0

    def add(self, texts: list[bytes], learn: bool) -> None:
        if learn:
            for text in texts:
                self.words.update(text.lower().split())
            self.words[_END_WORD] += len(texts)
        else:
            for text in texts:
                self.seen.update(text.lower().split())
            self.seen.add(_END_WORD)
        for codes, _ in _pieces(texts):
            grams, counts = np.unique(codes, return_counts=True)
            self.grams.append((grams, counts if learn else np.zeros(len(grams), np.int64)))
            self.n_grams += len(grams)
            if self.n_grams > _HELD_GRAMS:
                self.grams = [self._merged()]
                self.n_grams = len(self.grams[0][0])

    def _merged(self) -> tuple[np.ndarray, np.ndarray]:
        return _added(*[np.concatenate([g[k] for g in self.grams]) for k in range(2)])

    def held(self) -> int:
        return max(len(self.words) + len(self.seen), self.n_grams * _HELD_WORDS // (2 * _HELD_GRAMS))

    def rows(self, buckets: int) -> Iterator[tuple[int, int, bytes, bytes]]:
        """(kind, bucket, keys, counts)."""
        for word in self.seen:
            self.words.setdefault(word, 0)
        by_bucket: dict[int, list[bytes]] = {}
        for word in self.words:
            by_bucket.setdefault(zlib.crc32(word) % buckets, []).append(word)
        for bucket, words in by_bucket.items():
            yield WORDS, bucket, _packed_words(words), _packed(np.array([self.words[w] for w in words], np.int64))
        if self.grams:
            grams, counts = self._merged()
            bucket = _gram_buckets(grams, buckets)
            order = np.argsort(bucket, kind="stable")
            grams, counts, bucket = grams[order], counts[order], bucket[order]
            ends = np.r_[np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
            for start, end in zip(np.r_[0, ends[:-1]], ends, strict=True):
                yield GRAMS, int(bucket[start]), _packed(grams[start:end], rising=True), _packed(counts[start:end])


_REQUESTS = "chunk long, kind int, bucket int, keys binary, counts binary"


def _requested(buckets: int):
    """Rows (chunk, learn, text) to requests."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Requests] = {}

        def listed(chunk: int) -> Iterator[pa.RecordBatch]:
            kinds, places, keys, counts = zip(*held.pop(chunk).rows(buckets), strict=True)
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk] * len(kinds), pa.int64()), pa.array(kinds, pa.int32()), pa.array(places, pa.int32()),
                pa.array(keys, pa.binary()), pa.array(counts, pa.binary()),
            ], names=["chunk", "kind", "bucket", "keys", "counts"])

        for batch in batches:
            for start in range(0, batch.num_rows, _TEXTS):
                chunks, learn, texts = [c.to_pylist() for c in batch.slice(start, _TEXTS).columns]
                groups: dict[tuple[int, bool], list[bytes]] = {}
                for chunk, trains, text in zip(chunks, learn, texts, strict=True):
                    groups.setdefault((chunk, trains), []).append(text or b"")
                for (chunk, trains), own in groups.items():
                    held.setdefault(chunk, _Requests()).add(own, trains)
                while sum(r.held() for r in held.values()) > _HELD_WORDS:
                    yield from listed(max(held, key=lambda c: held[c].held()))
        for chunk in list(held):
            yield from listed(chunk)
    return task


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[column.to_pylist() for column in batch.columns], strict=True)


_SUMS = "kind int, bucket int, keys binary, counts binary, tokens long, kinds long"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests (kind, bucket, keys, counts), sorted by bucket, to one row per bucket. One bucket's distinct entries are held."""
    for (kind, bucket), rows in groupby(_streams(batches), key=lambda r: r[:2]):
        if kind == WORDS:
            total: dict[bytes, int] = {}
            for _, _, keys, blob in rows:
                for word, n in zip(_unpacked_words(keys), _unpacked(blob, np.int64).tolist(), strict=True):
                    total[word] = total.get(word, 0) + n
            counts, keys = np.fromiter(total.values(), np.int64, len(total)), _packed_words(list(total))
        else:
            parts, size = [], 0
            for _, _, keys, blob in rows:
                parts.append((_unpacked(keys, np.int64, rising=True), _unpacked(blob, np.int64)))
                size += len(parts[-1][0])
                if size > 2 * len(parts[0][0]) + _HELD_GRAMS:
                    parts = [_added(*[np.concatenate([p[k] for p in parts]) for k in range(2)])]
                    size = len(parts[0][0])
            grams, counts = _added(*[np.concatenate([p[k] for p in parts]) for k in range(2)])
            keys = _packed(grams, rising=True)
        yield pa.RecordBatch.from_arrays([
            pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([keys], pa.binary()), pa.array([_packed(counts)], pa.binary()),
            pa.array([int(counts.sum())], pa.int64()), pa.array([int(np.count_nonzero(counts))], pa.int64()),
        ], names=["kind", "bucket", "keys", "counts", "tokens", "kinds"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of grams (keys, counts) to the counts of their last two bytes."""
    total = np.zeros(1 << 16, np.int64)
    for keys, counts in _streams(batches):
        total += np.bincount(
            _unpacked(keys, np.int64, rising=True) & 0xFFFF, weights=_unpacked(counts, np.int64), minlength=1 << 16).astype(np.int64)
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["pair", "n"])


# The trie

def _low_orders(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Natural logarithms, by the last context byte and the symbol: met from this context, and when escaped from it.

    ``pairs`` holds the training counts of two neighbours.
    """
    c0 = pairs.sum(axis=0)
    total, kinds = c0.sum(), np.count_nonzero(c0)
    unseen = -math.log(max(1, _VALUES - kinds))
    with np.errstate(divide="ignore", invalid="ignore"):
        if total:
            order0 = np.where(c0 > 0, np.log((c0 - 0.5) / total), math.log(kinds / (2 * total)) + unseen)
        else:
            order0 = np.full(256, unseen)
        seen = pairs > 0
        t1, d1 = pairs.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
        left, kinds_left = total - (seen * c0).sum(axis=1, keepdims=True), kinds - d1
        escaped = np.where(
            left <= 0, unseen,
            np.where(c0 > 0, np.log((c0 - 0.5) / left), np.log(kinds_left / (2 * left)) + unseen),
        )
        met = np.where(
            t1 == 0, order0, np.where(seen, np.log((pairs - 0.5) / t1), np.log(d1 / (2 * t1)) + escaped))
    return met, escaped


def code_lengths(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The natural logarithm of each gram's last byte given those before it.

    ``grams`` are distinct and in order; for every context in them, all grams of contexts with the same last two bytes are there.
    Counts may be zero: asked for, but not learned.
    """
    levels = [(grams, counts, None)]
    for k in range(ORDER - 1, 1, -1):
        lower = levels[-1][0] & ((1 << 8 * (k + 1)) - 1)
        keys, position = np.unique(lower, return_inverse=True)
        levels.append((keys, np.bincount(position, weights=levels[-1][1], minlength=len(keys)), position))
    met, escaped = _low_orders(pairs)
    low_counts, low_seen = pairs.astype(float), pairs > 0
    low_total, low_kinds = low_counts.sum(axis=1), low_seen.sum(axis=1)
    below = None
    for level in range(len(levels) - 1, -1, -1):
        keys, c, _ = levels[level]
        c = np.asarray(c, float)
        if below is None:  # order 2 stands on the table of order 1
            last, symbol = keys >> 8 & 0xFF, keys & 0xFF
            lower = (low_counts[last, symbol], low_total[last], low_kinds[last].astype(float), met[last, symbol], escaped[last, symbol])
        else:
            position = levels[level + 1][2]
            lower = tuple(x[position] for x in below)
        c_low, t_low, d_low, met_low, escaped_low = lower
        context = keys >> 8
        starts = np.flatnonzero(np.r_[True, context[1:] != context[:-1]])
        size = np.diff(np.r_[starts, len(keys)])
        spread = lambda x, s=starts, n=size: np.repeat(np.add.reduceat(x, s), n)
        seen = c > 0
        t, d = spread(c), spread(seen.astype(float))
        left, kinds_left = t_low - spread(np.where(seen, c_low, 0.0)), d_low - d
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(
                left <= 0, escaped_low,
                np.where(c_low > 0, np.log((c_low - 0.5) / left), np.log(kinds_left / (2 * left)) + escaped_low))
            here = np.where(t <= 0, met_low, np.where(seen, np.log((c - 0.5) / t), np.log(d / (2 * t)) + escape))
        # Where the context itself was never seen, to escape from it is to meet the lower one.
        below = (c, t, d, here, np.where(t <= 0, met_low, escape))
    return below[3]


def _answered(pairs: np.ndarray):
    """Rows (kind, bucket, turn, chunk, keys, counts), a bucket's sums before the requests to it, to answers for the chunks."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, grams, values, words = None, None, None, None
        for kind, bucket, turn, chunk, keys, counts in _streams(batches):
            if turn == 0:
                held = (kind, bucket)
                if kind == WORDS:
                    words = dict(zip(_unpacked_words(keys), _unpacked(counts, np.int64).tolist(), strict=True))
                else:
                    grams = _unpacked(keys, np.int64, rising=True)
                    values = code_lengths(grams, _unpacked(counts, np.int64), pairs) / math.log(10)
                continue
            assert held == (kind, bucket)
            if kind == WORDS:
                found = np.array([words[w] for w in _unpacked_words(keys)], float)
            else:
                found = values[np.searchsorted(grams, _unpacked(keys, np.int64, rising=True))]
            yield pa.RecordBatch.from_arrays([
                pa.array([chunk], pa.int64()), pa.array([kind], pa.int32()), pa.array([keys], pa.binary()), pa.array([_packed(found)], pa.binary()),
            ], names=["chunk", "kind", "keys", "found"])
    return task


# Scoring

def _scored(id_type: pa.DataType, tokens: int, kinds: int):
    floor = tokens + SMOOTHING * (kinds + 1)
    unseen = math.log10(SMOOTHING / floor) if floor else 0.0

    def task(docs: pa.Table, answers: pa.Table) -> pa.Table:
        logs: dict[bytes, float] = {}
        parts = []
        for kind, keys, found in zip(*[answers.column(c).to_pylist() for c in ("kind", "keys", "found")], strict=True):
            if kind == WORDS:
                c = _unpacked(found, float)
                logs.update(zip(_unpacked_words(keys), np.where(c > 0, np.log10((c + SMOOTHING) / floor), unseen).tolist(), strict=True))
            else:
                parts.append((_unpacked(keys, np.int64, rising=True), _unpacked(found, float)))
        grams, values = [np.concatenate([p[k] for p in parts]) for k in range(2)] if parts else (np.zeros(0, np.int64), np.zeros(0))
        order = np.argsort(grams, kind="stable")
        grams, values = grams[order], values[order]
        texts = [t or b"" for t in docs.column("text").to_pylist()]
        scores = np.zeros(len(texts))
        for codes, text in _pieces(texts):
            # Sorted, so that neighbours are looked up in neighbouring places.
            keys = np.sort(codes | (text - text[0]) << 8 * (ORDER + 1))
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            times = np.diff(np.r_[starts, len(keys)])
            distinct = keys[starts]
            value = values[np.searchsorted(grams, distinct & ((1 << 8 * (ORDER + 1)) - 1))]
            part = np.bincount(distinct >> 8 * (ORDER + 1), weights=times * value)
            scores[text[0]:text[0] + len(part)] += part
        n_tokens, n_known, base = [], [], []
        for text in texts:
            own = text.lower().split()
            own.append(_END_WORD)
            found = list(map(logs.__getitem__, own))
            n_tokens.append(len(own))
            n_known.append(len(own) - found.count(unseen))
            base.append(math.fsum(found))
        return pa.table({
            "id": docs.column("id").combine_chunks().cast(id_type), "learn": docs.column("learn").combine_chunks(),
            "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "train_tokens": pa.array([tokens] * len(texts), pa.int64()), "base_score": pa.array(base, pa.float64()),
            "score": pa.array(scores, pa.float64()),
        })
    return task


def _megabytes(setting: str) -> float:
    text = setting.strip().lower().removesuffix("b")
    unit = {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1024**2}.get(text[-1:])
    return float(text[:-1]) * unit if unit else float(text) / 2**20


def _chunked(df: DataFrame, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """``df`` as (id, text, chunk, row), and the bytes of all texts.

    A chunk is a part, by a hash of id and text, of a split of the files. Splits are parted by the bytes that their texts have, which
    compressed files don't tell, so that no chunk is much larger than ``CHUNK_BYTES``; a frame that isn't read from files is one split.
    """
    split = [F.input_file_name().alias("file"), F.input_file_block_start().alias("start")]
    whole = F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")
    sizes = written(df.select(*split, F.octet_length(whole).alias("bytes")).groupBy("file", "start").agg(F.sum("bytes").alias("bytes")), "splits")
    size, most = sizes.agg(F.sum("bytes"), F.max("bytes")).first()
    parts = max(1, math.ceil(_megabytes(df.sparkSession.conf.get("spark.sql.files.maxPartitionBytes")) * 2**20 / CHUNK_BYTES))
    rows = df.select(F.struct(*[f"`{c}`" for c in df.columns]).alias("row"), *split, whole.alias("text"), F.col(f"`{doc_id}`").alias("id"))
    number = F.lit(parts).cast("long")
    if (most or 0) > parts * CHUNK_BYTES:
        # Only splits whose texts are larger than usual are named, so that this side stays small.
        large = sizes.where(F.col("bytes") > parts * CHUNK_BYTES).select("file", "start", F.ceil(F.col("bytes") / CHUNK_BYTES).alias("parts"))
        rows = rows.join(large, ["file", "start"], "left")
        number = F.coalesce("parts", number)
    own = F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), number)
    return rows.select("id", "text", F.xxhash64("file", "start", own).alias("chunk"), "row"), size or 0


def score_texts(
    df: DataFrame, learn: Column, *, doc_id: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per row of ``df``: id, ``learn``, token counts, word score and byte score (log10 probabilities).

    ``learn`` says which rows are learned from; null is no. ``df`` is read twice and must be a table in files.
    """
    marked, size = _chunked(df.withColumn("_learn", F.coalesce(learn, F.lit(False))), doc_id, text)
    rows = marked.select("chunk", F.col("row._learn").alias("learn"), "text", "id")
    chunks = math.ceil(size / CHUNK_BYTES) + 1
    buckets = math.ceil(8 * math.sqrt(chunks))
    asked = written(rows.select("chunk", "learn", "text").mapInArrow(_requested(buckets), _REQUESTS), "requests")
    place = ["kind", "bucket"]
    dealt = asked.select(*place, "keys", "counts").repartition(*place).sortWithinPartitions(*place)
    sums = written(dealt.mapInArrow(_summed, _SUMS), "sums")
    tokens, kinds = sums.where(F.col("kind") == WORDS).agg(F.sum("tokens"), F.sum("kinds")).first()
    pairs = np.zeros(1 << 16, np.int64)
    low = sums.where(F.col("kind") == GRAMS).select("keys", "counts").mapInArrow(_pairs, "pair long, n long")
    for row in low.groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 65,536 rows at most
        pairs[row["pair"]] = row["n"]

    salts = math.ceil(chunks / _ANSWER_CHUNKS)
    turns = sums.select(
        *place, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("turn"),
        F.lit(0).cast("long").alias("chunk"), "keys", "counts",
    ).unionByName(asked.select(
        *place, F.pmod("chunk", F.lit(salts)).cast("int").alias("salt"), F.lit(1).alias("turn"), "chunk", "keys",
        F.lit(None).cast("binary").alias("counts"),
    ))
    turns = turns.repartition(*place, "salt").sortWithinPartitions(*place, "salt", "turn").drop("salt")
    answers = turns.mapInArrow(_answered(pairs.reshape(256, 256)), "chunk long, kind int, keys binary, found binary")
    schema = T.StructType([
        rows.schema["id"], T.StructField("learn", T.BooleanType()),
        *[T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")],
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])
    task = _scored(to_arrow_type(rows.schema["id"].dataType), int(tokens or 0), int(kinds or 0))
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(task, schema).withColumnRenamed("id", doc_id)
