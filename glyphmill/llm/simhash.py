"""SimHash near-duplicates: exact links by vantage-point trees, and their components.

Fingerprints within ``radius`` bits agree on at least one of ``blocks`` bit blocks up to
radius // blocks bits, so one tree a block is searched with that smaller radius; the Hamming
distance of a block is a metric too and no more than the whole distance. A tree node holds a
vantage point and a threshold m: points at distance <= m go left, the others right. By the
triangle inequality a pair split by the node has one end on the left at distance > m - r, so
only these boundary points are sent right as well; every pair within the radius then meets in
some shard. The upper tree is fitted on a bounded sample and only decides where pairs meet;
each shard grows its own tree further and tests the whole fingerprints exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.common import bounded_batches, byte_view, checkpointed, small_slices, table, text_column, tidy

SEED = 42
#: Fingerprints that the upper tree is fitted on: at least, for each shard, and at most.
TREE_SAMPLE, SAMPLE_A_SHARD, LARGEST_SAMPLE = 8192, 8, 1 << 20
#: Distinct fingerprints aimed at in one shard of the upper tree.
SHARD_SIZE = 8000
#: Points of a shard that are compared with each other directly.
LEAF_SIZE = 256

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The SimHash of one text; 0 for a text without words."""
    data = text.translate(_LOWER)
    space = _SPACES[np.frombuffer(data, np.uint8)]
    edge = np.diff(np.concatenate(([1], space.astype(np.int8), [1])))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return 0
    if (starts[1:] - ends[:-1] != 1).any() or (b"\n" in data) or (b"\t" in data) or (b"\r" in data) or (b"\x0b" in data) or (b"\x0c" in data):
        lengths = ends - starts
        data = b" ".join(data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
        starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        ends = starts + lengths
    last = max(len(starts) - shingle + 1, 1)
    begin, end = starts[:last].tolist(), ends[min(shingle, len(ends)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(data[a:b], SEED) for a, b in zip(begin, end, strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8)
        ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long), one row for each input row.

    A null or blank text has fingerprint 0. Other columns of the input are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches, "text"):
            data, offsets = byte_view(text_column(batch, "text"))
            raw = data.tobytes()
            out = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["doc_id", "fp"])

    bounded_batches(docs)
    kind = docs.schema[id_col].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(tidy(run), f"doc_id {kind}, fp long")


def masks(blocks: int) -> list[int]:
    """64-bit masks of ``blocks`` blocks of neighbouring bits."""
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]


def _split(points: np.ndarray, radius: int, seed: int) -> tuple[np.uint64, int] | None:
    """A vantage point and a threshold that leave both sides smaller than the whole, or none."""
    rng = np.random.default_rng(seed)
    best, vantage, cut = len(points), None, 0
    for pick in rng.choice(len(points), min(6, len(points)), replace=False):
        counts = np.bincount(np.bitwise_count(points ^ points[pick]), minlength=66)
        left = np.cumsum(counts)
        for m in range(int(np.flatnonzero(counts)[0]), 64):
            both = left[m] - (left[m - radius] if m >= radius else 0) if radius else 0
            worst = max(left[m], len(points) - left[m] + both)
            if worst < best:
                best, vantage, cut = worst, points[pick], m
    return None if vantage is None or best > 0.9 * len(points) else (vantage, cut)


def fit_tree(sample: np.ndarray, mask: int, radius: int, leaves: int) -> list[tuple]:
    """Nodes (vantage, threshold, left, right); a negative child -1 - k is shard k."""
    nodes: list[tuple] = []
    shards = 0

    def grow(points: np.ndarray, parts: int) -> int:
        nonlocal shards
        cut = _split(points, radius, len(nodes)) if parts > 1 and len(points) >= 8 else None
        if cut is None:
            shards += 1
            return -shards
        at = len(nodes)
        nodes.append(())
        far = np.bitwise_count(points ^ cut[0])
        nodes[at] = (int(cut[0]), cut[1], grow(points[far <= cut[1]], parts // 2), grow(points[far > cut[1] - radius], parts - parts // 2))
        return at

    grow(np.unique(sample & np.uint64(mask)), leaves)
    return nodes


def route(points: np.ndarray, nodes: list[tuple], radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, positions in ``points``) of every shard that a point belongs to or overlaps."""
    stack = [(0 if nodes else -1, np.arange(len(points)))]
    while stack:
        at, own = stack.pop()
        if not len(own):
            continue
        if at < 0:
            yield -1 - at, own
            continue
        vantage, cut, left, right = nodes[at]
        far = np.bitwise_count(points[own] ^ np.uint64(vantage))
        stack.append((left, own[far <= cut]))
        stack.append((right, own[far > cut - radius]))


class Forest:
    """Union-find over positions; the smallest position is the root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self.root(i), self.root(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)


def shard_links(points: np.ndarray, mask: int, block_radius: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct ``points``: each linked point with its root."""
    points = np.sort(points)
    forest = Forest(len(points))
    part = points & np.uint64(mask)
    stack = [np.arange(len(points))]
    seed = 0
    while stack:
        own = stack.pop()
        seed += 1
        cut = _split(part[own], block_radius, seed) if len(own) > LEAF_SIZE else None
        if cut is None:
            for at in range(0, len(own), LEAF_SIZE):
                rows = own[at : at + LEAF_SIZE]
                for to in range(at, len(own), 4096):
                    columns = own[to : to + 4096]
                    near = np.bitwise_count(points[rows][:, None] ^ points[columns][None, :]) <= radius
                    i, j = np.nonzero(near)
                    i, j = rows[i], columns[j]
                    fresh = (i < j) & (forest.up[i] != forest.up[j])
                    forest.join(i[fresh], j[fresh])
            continue
        far = np.bitwise_count(part[own] ^ cut[0])
        stack += [own[far <= cut[1]], own[far > cut[1] - block_radius]]
    roots = np.array([forest.root(i) for i in range(len(points))], np.int64) if len(points) else np.zeros(0, np.int64)
    linked = np.flatnonzero(roots != np.arange(len(points)))
    return points[linked], points[roots[linked]]


def links(distinct: DataFrame, radius: int = 3, blocks: int = 2) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints that links of the radius connect.

    ``distinct`` has each fp once. Duplicated edges of several shards may appear.
    """
    spark = distinct.sparkSession
    count = distinct.count()
    block_radius, of_block = radius // blocks, masks(blocks)
    leaves = max(1, -(-count // SHARD_SIZE))
    # The sample grows with the shards (to 8 MB, enough for a billion distinct fingerprints); it only decides where pairs meet.
    size = min(max(TREE_SAMPLE, SAMPLE_A_SHARD * leaves), LARGEST_SAMPLE)
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(size).toArrow().column("fp").to_numpy().view(np.uint64)
    leaves = min(leaves, max(1, len(sample) // SAMPLE_A_SHARD))
    trees = spark.sparkContext.broadcast([fit_tree(sample, m, block_radius, leaves) for m in of_block])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k, nodes in enumerate(trees.value):
                for shard, own in route(points & np.uint64(of_block[k]), nodes, block_radius):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard * blocks + k, np.int64)), pa.array(points[own].view(np.int64))], ["shard", "fp"])

    def solve(key: tuple, rows: pa.Table) -> pa.Table:
        points = rows.column("fp").to_numpy().view(np.uint64)
        a, b = shard_links(points, of_block[key[0].as_py() % blocks], block_radius, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = distinct.select("fp").mapInArrow(tidy(deal), "shard long, fp long")
    return dealt.groupBy("shard").applyInArrow(solve, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's smallest node) for every node of the edges (a, b).

    Alternates large-star and small-star steps until no edge changes, which takes a number of
    rounds that grows with the square of the logarithm of the nodes at most. Both steps only take
    minima and distinct edges; the neighbours of a node are never gathered in one place.
    """
    current = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e"))
        after = checkpointed(small.select("e.u", "e.v").where("u <> v").distinct())
        done = after.count() == current.count() and after.exceptAll(current).isEmpty()
        current = after
        if done:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 3, blocks: int = 2, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable by links), a row for each input row.

    Links are those of the fingerprints of ``shingle`` words within ``radius`` bits. A wider radius asks for
    more ``blocks``, so that radius // blocks stays small beside the 64 // blocks bits of each.
    Null and blank texts share fingerprint 0 and link like others. Rows with a null id take part;
    a component whose ids are all null has a null component_id. An empty table gives no rows.
    Equal texts meet as one fingerprint before anything is compared.
    """
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    distinct = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = components(links(distinct, radius, blocks))
    rooted = distinct.join(found, distinct.fp == found.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = checkpointed(rooted.join(smallest, "root").select(F.col("fp").alias("of_fp"), "component_id"))
    return prints.join(classes, prints.fp == classes.of_fp).select("doc_id", "fp", "component_id")


def op5(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
