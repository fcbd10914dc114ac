"""Near-duplicate documents by SimHash fingerprints and BK-trees.

A fingerprint has a bit for each of the 64 bits of the XXH64 values (seed 42) of a document's three-word shingles: one if
more than half of the values have it. Equal fingerprints are one point, so copies cost nothing further.

Points meet in shards of some thousands: three groups of bits are set apart, each as wide as the number of points asks for, and a
point is put under the value of each group. Two points that differ in two bits or fewer agree in at least one of three
groups, so they share a shard. A shard of more than ``SHARD_POINTS`` points is split again, by thirds of the bits that its points may still
differ in, and so on until no shard is larger; with ``LEAST_OPEN`` open bits left none can be.

Every shard is searched by its own BK-tree: children are keyed by the Hamming distance to the parent, and a search
follows only edges within the radius of its distance. Points are visited breadth first, so each is searched for once
and a shard yields one link per point to the first of its component, never all pairs. Trees are built where their points
were shuffled to: all of them together grow with the data, so none is broadcast. The links of all shards are joined
to components by Spark; no fingerprints, links or components come to the driver.

Defined results: ASCII letters are lower-cased; words are parted by ASCII white space; a text of one or two words is one
shingle; null, empty and blank texts have fingerprint zero; a component's id is the smallest id in it, nulls
aside (null if it has none but nulls); repeated rows give repeated result rows; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from portfold.llm.components import components
from portfold.llm.support import written

SHINGLE_WORDS = 3
SEED = 42
RADIUS = 2
SHARD_POINTS = 1 << 14
LEAF_POINTS = 32
LEAST_OPEN = 14
_SUM_ROWS = 1 << 15
_QUERY_ROWS = 1 << 14


def shingles(text: bytes) -> list[bytes]:
    parts = text.lower().split()
    if len(parts) < SHINGLE_WORDS:
        return [b" ".join(parts)] if parts else []
    return list(map(b" ".join, zip(*[parts[k:] for k in range(SHINGLE_WORDS)], strict=False)))


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of a UTF-8 text, unsigned."""
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles(text)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), _SUM_ROWS):
        part = hashes[start:start + _SUM_ROWS].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = 2 * ones > len(hashes)
    return int(np.packbits(set_bits, bitorder="little").view("<u8")[0])


def _with_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the last column, the text as bytes, by the fingerprint as a signed long."""
    for batch in batches:
        values = np.array([fingerprint(text or b"") for text in batch.column(batch.num_columns - 1).to_pylist()], dtype=np.uint64)
        columns = [*batch.columns[:-1], pa.array(values.view(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "fp"])


class BKTree:
    """Points in a tree whose children are keyed by the Hamming distance to their parent; small subtrees are leaves."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.nodes: list[tuple[np.ndarray, dict[int, int]]] = []  # its own points, and its children by distance
        waiting = [(np.arange(len(points)), None, 0)]
        while waiting:
            members, parent, key = waiting.pop()
            if parent is not None:
                self.nodes[parent][1][key] = len(self.nodes)
            if len(members) <= LEAF_POINTS:
                self.nodes.append((members, {}))
                continue
            self.nodes.append((members[:1], {}))
            rest = members[1:]
            distance = np.bitwise_count(points[rest] ^ points[members[0]])
            waiting += [(rest[distance == d], len(self.nodes) - 1, int(d)) for d in np.unique(distance)]

    def matches(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For every node that is visited: its points, the queries that reached it, and which of them are in reach."""
        waiting = [(0, queries[start:start + _QUERY_ROWS]) for start in range(0, len(queries), _QUERY_ROWS)]
        while waiting:
            node, asked = waiting.pop()
            own, children = self.nodes[node]
            distance = np.bitwise_count(self.points[own][:, None] ^ self.points[asked][None, :]).astype(np.int16)
            yield own, asked, distance <= radius
            for key, child in children.items():
                follow = asked[np.abs(distance[0] - key) <= radius]
                if len(follow):
                    waiting.append((child, follow))


def linked(points: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each of the distinct points the position of the first point of its component."""
    first = np.arange(len(points))
    tree = BKTree(points)
    neighbours = np.zeros(len(points), dtype=np.int64)
    for _, asked, near in tree.matches(first, radius):
        np.add.at(neighbours, asked, near.sum(axis=0))
    seen = neighbours < 2  # only itself
    for start in np.flatnonzero(~seen):
        if seen[start]:
            continue
        frontier = np.array([start])
        seen[start] = True
        while len(frontier):
            found = np.zeros(len(points), dtype=bool)
            for own, _, near in tree.matches(frontier, radius):
                found[own] |= near.any(axis=1)
            frontier = np.flatnonzero(found & ~seen)
            seen[frontier] = True
            first[frontier] = start
    return first


def _links_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    points = np.sort(points)
    first = linked(points.view(np.uint64))
    tied = np.flatnonzero(first != np.arange(len(points)))
    return points[tied], points[first[tied]]


def _shard_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (mask, value, fp), sorted by shard, to links. One shard is held at a time."""
    held_key, held = None, []

    def result() -> Iterator[pa.RecordBatch]:
        points = np.concatenate(held) if held else np.empty(0, np.int64)
        if len(points) > 1:
            u, v = _links_of(points)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2)], axis=1)
        points = batch.column(2).to_numpy(zero_copy_only=False)
        ends = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for start, end in zip([0, *ends], [*ends, len(points)], strict=True):
            key = tuple(keys[start])
            if key != held_key:
                yield from result()
                held_key, held = key, []
            held.append(points[start:end])
    yield from result()


def _mask(bits: list[int]) -> int:
    """These bits as a signed long."""
    value = sum(1 << b for b in bits)
    return value - (1 << 64) if value >> 63 else value


def _thirds(mask: int, width: int | None = None) -> list[int]:
    """``mask`` with a third of its open bits each, or ``width`` of them: points within two bits agree under one of the three."""
    opened = [b for b in range(64) if not mask >> b & 1]
    width = len(opened) // 3 if width is None else width
    fixed = [b for b in range(64) if mask >> b & 1]
    return [_mask(fixed + opened[k * width:(k + 1) * width]) for k in range(3)]


def links(points: DataFrame, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Links ``u``, ``v`` between the distinct fingerprints ``fp``: the same components as all pairs within the radius."""
    width = min(21, max(0, (points.count() * 4 // shard_points).bit_length() - 1))
    masks = _thirds(0, width) if width else [0]
    rows = points.select("fp", F.explode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("mask"))
    found = None
    while True:
        rows = written(rows.withColumn("value", F.col("fp").bitwiseAND(F.col("mask"))), "keyed")
        sizes = rows.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1")
        # Another form of the key, so that no partitioning is reused and Spark may split a hot shard's points.
        sizes = sizes.select(F.concat_ws(" ", "mask", "value").alias("shard"), (F.col("n") > shard_points).alias("large"))
        sized = written(rows.withColumn("shard", F.concat_ws(" ", "mask", "value")).join(sizes, "shard").drop("shard"), "shards")
        dealt = sized.where("not large").select("mask", "value", "fp").repartition("mask", "value").sortWithinPartitions("mask", "value")
        part = dealt.mapInArrow(_shard_links, "u long, v long")
        found = part if found is None else found.unionByName(part)
        large = sized.where("large")
        masks = [m for m in masks if 64 - (m & (1 << 64) - 1).bit_count() > LEAST_OPEN]
        if not masks or large.isEmpty():
            return found.distinct()
        below = {m: _thirds(m) for m in masks}
        children = F.create_map(*[x for m, ms in below.items() for x in (F.lit(m).cast("long"), F.array(*[F.lit(c).cast("long") for c in ms]))])
        rows = large.select("fp", F.explode(F.element_at(children, F.col("mask"))).alias("mask"))
        masks = sorted({c for ms in below.values() for c in ms})


def _other_form(name: str) -> Column:
    """The key as text: joined by it, no partitioning of an aggregate is reused, and Spark may split a hot key."""
    return F.col(name).cast("string")


def _components_of(rows: DataFrame) -> DataFrame:
    """``fp`` and ``component_id`` of every fingerprint in the written ``rows`` (id, fp)."""
    points = written(rows.groupBy("fp").agg(F.min("id").alias("least")), "points")
    roots = components(links(points)).withColumnRenamed("node", "fp")
    rooted = points.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    rooted = rooted.select(_other_form("root").alias("_root"), "component_id")
    tied = roots.join(rooted, _other_form("root") == F.col("_root")).select("fp", "component_id", F.lit(True).alias("tied"))
    of_point = F.when(F.col("tied"), F.col("component_id")).otherwise(F.col("least"))
    return written(points.join(tied, "fp", "left").select("fp", of_point.alias("component_id")), "components")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: its id, fingerprint (16 hexadecimal digits) and component id."""
    slim = df.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_bytes"))
    schema = T.StructType([slim.schema["id"], T.StructField("fp", T.LongType())])
    rows = written(slim.mapInArrow(_with_fingerprints, schema), "fingerprints")
    return rows.join(_components_of(rows), "fp").select(
        F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
    )


def drop_near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component with all its columns: the one with the smallest id.

    A row without an id stays only if its component has none with one. Of several rows with that id one stays. Rows are told apart by
    their place and components by their root, so different texts that share an id stay apart.
    """
    names = [f"`{c}`" for c in df.columns]
    packed = df.select(F.struct(*names).alias("_row"), F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("_bytes"))
    schema = T.StructType([*packed.schema.fields[:-1], T.StructField("fp", T.LongType())])
    rows = packed.mapInArrow(_with_fingerprints, schema).withColumn("node", F.monotonically_increasing_id())
    rows = written(rows, "fingerprints")
    first = F.min(F.struct(F.col("id").isNull().alias("nameless"), "id", "node"))
    points = written(rows.groupBy("fp").agg(first.alias("first"), F.count("*").alias("n")), "points")
    roots = components(links(points.select("fp"))).withColumnRenamed("node", "fp")
    rooted = written(points.join(roots, "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root")), "roots")
    stays = rooted.groupBy("root").agg(F.min("first").alias("stays"), F.sum("n").alias("rows")).where("rows > 1")
    stays = stays.select(_other_form("root").alias("_root"), "stays")
    # Only rows of components with several rows are named, so that Spark can send this side to the texts where it is small.
    several = rooted.join(stays, _other_form("root") == F.col("_root")).select(F.col("fp").alias("_fp"), F.col("stays.node").alias("_stays"))
    dropped = written(rows.select("node", "fp").join(several, F.col("fp") == F.col("_fp")).where("node <> _stays").select("node"), "dropped")
    return rows.join(dropped, "node", "left_anti").select("_row.*")
