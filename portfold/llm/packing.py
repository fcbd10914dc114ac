"""Cost-balanced packing of documents into training sequences.

Every document is tokenised whole and closed by an end token. A sequence holds at most ``length`` tokens. Each task
packs its own partition in windows of ``WINDOW_TOKENS`` tokens, so memory is bound by a window and one document, nothing is
shuffled, and a task that runs again repeats its own work alone.

In a window, whole lengths are cut off long documents and fill sequences of their own. The remainders are placed in
descending order of cost, where a piece of n tokens costs ``LINEAR`` * n + ``QUADRATIC`` * n^2 (attention within the piece),
each into the cheapest sequence that has room for it; one that fits nowhere is cut at the cheapest sequence with room. There
are as many sequences as the tokens need, so a window leaves less than one sequence of padding.

Ids are looked up per space-parted word, as no token of this vocabulary spans a space that stands between
two other characters. Words that a task doesn't know yet are gathered over ``GROUP_CHARS`` of texts, cut as the vocabulary cuts them
into letters, digits, marks and line ends where they hold none but plain characters, and only what is new of these pieces is encoded by
the library, in one call. Both tables of a worker hold ``KNOWN_BYTES`` at most and are emptied beyond that; the bound only
decides what is encoded again.

Defined results: null text is empty, and a document without tokens is its end token; strings of special tokens in a text
are ordinary text; null and repeated ids and repeated rows are packed like others; an empty table gives an empty
result.
"""

import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LENGTH = 2048
END = 1
WINDOW_TOKENS = 1 << 21
LINEAR = 1.0
QUADRATIC = 1.0 / 8192
KNOWN_BYTES = 384 << 20
GROUP_CHARS = 1 << 22
_ENTRY_BYTES = 160
# White space other than the plain space and the line end, ASCII and all.
_OTHER_ASCII_SPACE = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_OTHER_SPACE = re.compile(r"[^\S \n]")
_PLAIN_SPACE = re.compile(r"(?<=\S) (?=\S)")
# How the vocabulary cuts words of the characters of _SIMPLE, which are letters, digits, marks, spaces and line ends.
_SIMPLE = re.compile(r"[\n -~À-ɏ]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[!-/:-@\[-`{-~×÷]+|\s+(?!\S)|\s+")


def _plainly_spaced(text: str) -> bool:
    """Whether all white space is single spaces and line ends, no space next to another of them."""
    if "  " in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in _OTHER_ASCII_SPACE) if text.isascii() else not _OTHER_SPACE.search(text)


def cost(tokens: np.ndarray) -> np.ndarray:
    return LINEAR * tokens + QUADRATIC * tokens * tokens


class Encoder:
    """Ids of texts as little-endian 32-bit bytes."""

    def __init__(self, vocabulary: str, known_bytes: int = KNOWN_BYTES) -> None:
        # One thread per task: Spark runs as many tasks as there are cores.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.words: dict[str, bytes] = {}  # by the word, with the space before it
        self.pieces: dict[str, bytes] = {}
        self.room = self.known_bytes = known_bytes

    def _learn(self, words: list[str]) -> None:
        """Puts words, each with the space before it, into the table."""
        simple, findall = _SIMPLE.fullmatch, _PIECES.findall
        cut = [findall(" " + w) if simple(w) else [" " + w] for w in words]
        self._learn_pieces(set(chain.from_iterable(cut)))
        ids_of, pieces = self.words, self.pieces
        for w, parts in zip(words, cut, strict=True):
            ids_of[w] = pieces[parts[0]] if len(parts) == 1 else b"".join([pieces[p] for p in parts])
        self.room -= len(words) * _ENTRY_BYTES + sum(map(len, words)) + sum(len(ids_of[w]) for w in words)

    def _learn_pieces(self, wanted: set[str]) -> None:
        new = list(wanted.difference(self.pieces))
        ids = [array("I", x.ids).tobytes() for x in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        self.pieces.update(zip(new, ids, strict=True))
        self.room -= len(new) * _ENTRY_BYTES + sum(map(len, new)) + sum(map(len, ids))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of every text. What it needs grows with the texts' size, so pass some megabytes at a time."""
        if not texts:
            return []
        if self.room < 0:
            self.words.clear()
            self.pieces.clear()
            self.room = self.known_bytes
        parted = [t.split(" ") if _plainly_spaced(t) else _PLAIN_SPACE.split(t) for t in texts]
        self._learn(list(set(chain.from_iterable([parts[1:] for parts in parted])).difference(self.words)))
        self._learn_pieces({parts[0] for parts in parted})  # no space stands before the first word
        return [b"".join([self.pieces[parts[0]], *map(self.words.__getitem__, parts[1:])]) for parts in parted]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(vocabulary: str) -> Encoder:
    """One per Python worker, which Spark uses for many tasks."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


def _slices(text: str) -> Iterator[str]:
    """The text, cut at plain spaces where it is longer than a group; ids of slices follow each other as in the text."""
    start = 0
    while len(text) - start > GROUP_CHARS and (cut := _PLAIN_SPACE.search(text, start + GROUP_CHARS)):
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:]


def _encoded(encoder: Encoder, texts: Iterable[str]) -> Iterator[bytes]:
    """The ids of every text, group by group."""
    group, chars = [], 0
    for text in texts:
        if group and chars + len(text) > GROUP_CHARS:
            yield from encoder.encode(group)
            group, chars = [], 0
        if len(text) > GROUP_CHARS:
            yield b"".join([encoder.encode([part])[0] for part in _slices(text)])
            continue
        group.append(text)
        chars += len(text)
    yield from encoder.encode(group)


def packed(lengths: np.ndarray, length: int) -> list[tuple[int, int, int, int]]:
    """Pieces (document, start, tokens, sequence) of documents with these token counts; sequences from 0.

    The pieces of a sequence are in the order in which they were put there.
    """
    pieces, sequences = [], 0
    for doc in np.flatnonzero(lengths >= length):
        for start in range(0, int(lengths[doc]) - length + 1, length):
            pieces.append((int(doc), start, length, sequences))
            sequences += 1
    rests = lengths % length
    count = -(-int(rests.sum()) // length)
    spent, room = np.zeros(count), np.full(count, length, dtype=np.int64)
    # Cost grows with tokens, so the order of tokens is the order of cost; ties go by position.
    order = np.argsort(-rests, kind="stable")
    waiting = [(int(lengths[d] - rests[d]), int(rests[d]), int(d)) for d in order[::-1] if rests[d]]
    while waiting:
        start, tokens, doc = waiting.pop()
        fits = room >= tokens
        if not fits.any():
            fits = room > 0
        at = int(np.where(fits, spent, np.inf).argmin())
        put = min(tokens, int(room[at]))
        pieces.append((doc, start, put, sequences + at))
        room[at] -= put
        spent[at] += cost(put)
        if put < tokens:
            # The rest of a cut piece waits for its turn by size.
            rest = (start + put, tokens - put, doc)
            place = len(waiting)
            while place and waiting[place - 1][1] > rest[1]:
                place -= 1
            waiting.insert(place, rest)
    return pieces


def _schema(id_type: T.DataType, with_ids: bool) -> T.StructType:
    long = T.LongType()
    fields = [("doc_id", id_type), ("start", long), ("length", long), ("ids_crc32", long), ("doc_tokens", long),
              ("sequence_id", long), ("offset", long), ("cost", T.DoubleType())]
    if with_ids:
        fields.append(("ids", T.ArrayType(T.IntegerType())))
    return T.StructType([T.StructField(*f) for f in fields])


def pack(
    df: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", *, length: int = LENGTH,
    end: int = END, window_tokens: int = WINDOW_TOKENS, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: document, start in it, length, CRC-32 of its ids, the document's tokens, sequence, offset there, cost.

    ``vocabulary`` is the path of a tokenizer file that every executor has. ``with_ids`` adds the ids themselves.
    Sequence ids are unique: the task's number times 2^32 plus a count. The caller's rows keep their partitions.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(vocabulary)
        close = np.array([end], dtype="<u4").tobytes()
        next_sequence = TaskContext.get().partitionId() << 32
        docs: list[bytes] = []
        names: list[pa.Array] = []
        waiting = 0

        def window() -> pa.RecordBatch:
            nonlocal next_sequence
            lengths = np.array([len(d) // 4 for d in docs], dtype=np.int64)
            pieces = np.array(packed(lengths, length), dtype=np.int64).reshape(-1, 4)
            pieces = pieces[np.argsort(pieces[:, 3], kind="stable")]
            doc, start, tokens, sequence = pieces.T
            first = np.r_[True, sequence[1:] != sequence[:-1]]
            ends = np.cumsum(tokens)
            begin = (ends - tokens)[first]
            offset = ends - tokens - np.repeat(begin, np.diff(np.r_[np.flatnonzero(first), len(sequence)]))
            cut = [docs[d][4 * s:4 * (s + n)] for d, s, n in zip(doc, start, tokens, strict=True)]
            ids = pa.chunked_array(names).take(pa.array(doc)).combine_chunks()
            columns = [
                ids, pa.array(start), pa.array(tokens), pa.array([zlib.crc32(c) for c in cut], pa.int64()), pa.array(lengths[doc]),
                pa.array(sequence + next_sequence), pa.array(offset), pa.array(cost(tokens.astype(float))),
            ]
            if with_ids:
                columns.append(pa.array([np.frombuffer(c, "<i4") for c in cut], pa.list_(pa.int32())))
            next_sequence += int(sequence[-1]) + 1
            return pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            begun = 0
            for i, ids in enumerate(_encoded(encoder, (t.as_py() or "" for t in batch.column(1)))):
                docs.append(ids + close)
                waiting += len(docs[-1]) // 4
                if waiting >= window_tokens:
                    names.append(batch.column(0).slice(begun, i + 1 - begun))
                    yield window()
                    docs, names, waiting, begun = [], [], 0, i + 1
            if begun < batch.num_rows:
                names.append(batch.column(0).slice(begun))
        if docs:
            yield window()

    schema = _schema(df.schema[doc_id].dataType, with_ids)
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(task, schema)
