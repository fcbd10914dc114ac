"""Periodic runs in the word sequences of documents.

A run is a stretch of words with smallest period q, at least max(``LEAST_LENGTH``, 2q) words long, that no neighbouring word
extends. All runs of a sequence are found by their Lyndon roots: for both orders of the alphabet, the longest Lyndon word at each position
ends before the next smaller suffix, and each run has such a word as its root in one of the orders. A candidate root [i, j) is
extended to the right by the longest common extension (LCE) of the suffixes at i and j and to the left by that of the reversed
prefixes before them; if the whole is at least twice the root, it is a run.

Extensions come from suffix trees of the sequence and of its reversal, built online by Ukkonen's algorithm. Of a tree's Euler
tour the least depth between neighbouring leaves is kept, and a sparse table over it answers the depth of the lowest
common ancestor of any two leaves in constant time, for all candidates of a document at once.

Before that, words that cannot lie in a run are set aside, which loses nothing: a run of length L and period q repeats its
first L - q >= ``LEAST_LENGTH`` / 2 words at distance q <= L / 2, so each of its words lies in a window of ``LEAST_LENGTH`` // 2 words that
occurs again no further away than half the stretch. Trees are built for such stretches only; a run lies in one of them
whole. Window hashes that collide only keep more words.

A document is one row and is worked on whole, in memory of its own size; nothing is shuffled.

Defined results: words are parted by ASCII white space; null, empty and blank texts have no words and no runs; ids are only carried, so
null and repeated ids and repeated rows are treated like others; other input columns are left out; an empty table gives an
empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_LENGTH = 12
_ROUNDS = 8
_FACTORS = np.random.default_rng(7).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class SuffixTree:
    """Ukkonen's suffix tree of a list of whole numbers from 1; 0 closes it and is smaller than all.

    Node 0 is the root. Leaves come in the order of their suffixes.
    """

    def __init__(self, sequence: list[int]) -> None:
        text = [*sequence, 0]
        self.text, n = text, len(text)
        start, end, link, children = [0], [0], [0], [{}]
        leaves: list[int] = []
        node = edge = length = remaining = 0
        for i, symbol in enumerate(text):
            unlinked = 0
            remaining += 1
            while remaining:
                if not length:
                    edge = i
                first = text[edge]
                child = children[node].get(first)
                if child is None:
                    children[node][first] = len(start)
                    branch = node
                else:
                    span = end[child] - start[child]
                    if length >= span:
                        edge, length, node = edge + span, length - span, child
                        continue
                    at = start[child] + length
                    if text[at] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    branch = len(start)
                    children[node][first] = branch
                    children.append({text[at]: child, symbol: branch + 1})
                    start.append(start[child])
                    end.append(at)
                    link.append(0)
                    start[child] = at
                leaves.append(len(start))
                children.append(None)
                start.append(i)
                end.append(n)
                link.append(0)
                if unlinked:
                    link[unlinked] = branch
                unlinked = branch if child is not None else 0
                remaining -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - remaining + 1
        self.start, self.end, self.children, self.leaves = start, end, children, leaves

    def tour(self, backwards: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes in their order, and the least depth on the Euler tour before each; ``backwards`` turns the alphabet round.

        The closing 0 is the smallest in either order.
        """
        suffix_of = dict(zip(self.leaves, range(len(self.leaves)), strict=True))
        start, end, children = self.start, self.end, self.children
        order, depths, least = [], [], 0
        waiting = [(0, 0)]
        while waiting:
            node, above = waiting.pop()
            least = min(least, above)
            below = children[node]
            if below is None:
                order.append(suffix_of[node])
                depths.append(least)
                least = len(self.text)
                continue
            depth = above + end[node] - start[node]
            # The last one pushed is visited first.
            symbols = sorted(below, reverse=not backwards)
            if backwards and symbols[0] == 0:
                symbols = [*symbols[1:], 0]
            waiting += [(below[s], depth) for s in symbols]
        return np.array(order), np.array(depths)


class Extensions:
    """Longest common extensions of suffixes, from the order and depths of a tour, by a sparse table of least depths."""

    def __init__(self, order: np.ndarray, depths: np.ndarray) -> None:
        self.rank = np.empty(len(order), dtype=np.int64)
        self.rank[order] = np.arange(len(order))
        self.levels = [depths.astype(np.int32)]
        width = 1
        while 2 * width <= len(depths):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of different positions how many words agree from there on."""
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b]) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        found = np.empty(len(low), dtype=np.int64)
        for k in np.unique(level):
            mine, table = level == k, self.levels[k]
            found[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << k)])
        return found


def next_smaller(rank: list[int]) -> list[int]:
    """For each position the next one of smaller rank, the length if there is none."""
    after = [len(rank)] * len(rank)
    for i in range(len(rank) - 2, -1, -1):
        own, j = rank[i], i + 1
        while j < len(rank) and rank[j] > own:
            j = after[j]
        after[i] = j
    return after


def runs_of_sequence(sequence: list[int], least_length: int = LEAST_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period, of a sequence of whole numbers from 1."""
    n = len(sequence)
    if n < max(2, least_length):
        return np.empty((0, 3), dtype=np.int64)
    tree = SuffixTree(sequence)
    order, depths = tree.tour()
    forward = Extensions(order, depths)
    turned = np.empty(n + 1, dtype=np.int64)
    turned[tree.tour(backwards=True)[0]] = np.arange(n + 1)
    del tree
    backward = Extensions(*SuffixTree(sequence[::-1]).tour())
    found = []
    for rank in (forward.rank, turned):
        after = np.array(next_smaller(rank[:n].tolist()))
        i = np.flatnonzero(2 * (after - np.arange(n)) <= n)
        j = after[i]
        i, j = i[j < n], j[j < n]
        right = forward.of(i, j)
        left = backward.of(n - i, n - j)
        period = j - i
        length = right + left + period
        kept = length >= np.maximum(least_length, 2 * period)
        found.append(np.stack([i - left, length, period], axis=1)[kept])
    rows = np.unique(np.concatenate(found), axis=0)
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def stretches(hashes: np.ndarray, least_length: int = LEAST_LENGTH) -> list[tuple[int, int]]:
    """Disjoint stretches (start, stop) of a sequence of word hashes, one of which holds each run whole."""
    gram = max(1, least_length // 2)
    if len(hashes) < max(least_length, 2):
        return []
    windows = sum(hashes[k:len(hashes) - gram + 1 + k] * _FACTORS[k % len(_FACTORS)] * np.uint64(2 * (k // len(_FACTORS)) + 1) for k in range(gram))
    done, waiting = [], [(0, len(hashes), 0)]
    while waiting:
        start, stop, turn = waiting.pop()
        own = windows[start:stop - gram + 1]
        place = np.argsort(own, kind="stable")
        distance = place[1:] - place[:-1]
        again = np.flatnonzero((own[place[1:]] == own[place[:-1]]) & (distance <= (stop - start) // 2))
        if not len(again):
            continue
        covered = np.zeros(stop - start + 1, dtype=np.int64)
        marked = np.zeros(len(own), dtype=bool)
        marked[place[again]] = marked[place[again + 1]] = True
        at = np.flatnonzero(marked)
        np.add.at(covered, at, 1)
        np.add.at(covered, at + gram, -1)
        inside = np.r_[False, np.cumsum(covered[:-1]) > 0, False]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + start
        parts = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2], strict=True) if b - a >= least_length]
        if parts == [(start, stop)] or turn == _ROUNDS:
            done += parts
        else:
            waiting += [(a, b, turn + 1) for a, b in parts]
    return sorted(done)


def runs_of_words(parts: list[bytes], least_length: int = LEAST_LENGTH) -> np.ndarray:
    """Rows (start, length, period) of all runs of a text's words, by start and period."""
    hashes = np.fromiter(map(hash, parts), dtype=np.int64, count=len(parts)).view(np.uint64)
    found = [np.empty((0, 3), dtype=np.int64)]
    for start, stop in stretches(hashes, least_length):
        numbers: dict[bytes, int] = {}
        sequence = [numbers.setdefault(w, len(numbers) + 1) for w in parts[start:stop]]
        found.append(runs_of_sequence(sequence, least_length) + np.array([start, 0, 0]))
    return np.concatenate(found)


def collapsed(parts: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words but for those that a run holds after its first period."""
    if not len(runs):
        return parts
    change = np.zeros(len(parts) + 1, dtype=np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return [parts[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]


def find_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", *, least_length: int = LEAST_LENGTH) -> DataFrame:
    """One row per row of ``df``: its id, ``runs`` (array of start, length, period by start and period), ``collapsed`` text."""
    struct = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, sizes, texts = [], [0], []
            for value in batch.column(1):
                parts = (value.as_py() or b"").split()
                runs = runs_of_words(parts, least_length)
                numbers.append(runs)
                sizes.append(len(runs))
                texts.append(b" ".join(collapsed(parts, runs)))
            flat = np.concatenate([np.empty((0, 3), dtype=np.int64), *numbers])
            values = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(struct))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.binary()).cast(pa.string())], names=["id", "runs", "collapsed"])

    rows = df.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL(
        "runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string").fields])
    return rows.mapInArrow(task, schema).withColumnRenamed("id", doc_id)


def longest(runs: Column) -> Column:
    """The longest of the runs; of several the one with the smallest start, then period; null if there is none."""
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    return F.when(best.isNotNull(), F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
