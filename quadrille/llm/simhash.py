"""SimHash near-duplicates: exact links within a Hamming radius, found by vantage-point trees across shards.

Fingerprints are first made distinct, so copies cost nothing more. They are partitioned by vantage-point trees: a node
compares the distance to its vantage point with a threshold, and its leaves are the shards. The fingerprint's home is one leaf
of each tree; where the triangle inequality lets a partner live beyond a threshold, a copy goes along as a query to the shards across
that boundary. Distances of 64-bit fingerprints crowd round 32 with a deviation of 4, so a ball of radius 4 would cross most
thresholds. There are therefore three trees, each with the Hamming distance of one third of the bits: two fingerprints
within r bits are within r // 3 bits in some third, and a ball of radius 1 crosses few thresholds. Where the points of
a node agree in that third, it goes on by the whole distance. The trees' nodes are chosen on the driver from a bounded sample
of fingerprints, which shapes the shards only: every fingerprint goes through every tree, and the links are exact.

Inside a shard a tree of the same kind over all bits finds the pairs. Each shard emits a spanning forest of its
links, never all pairs of a group, and the forest's edges are contracted to components.

Rows: null and empty texts have no words, so their fingerprint is zero, linked like any other; texts of fewer words than a
shingle have one shingle of all their words. Each row of the input gives one row. component_id is the smallest
doc_id reachable; a null doc_id never is (a component of null ids only has a null component_id).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import common
from quadrille.llm.graph import components, join_on_hot

BITS = 64
ALL = (1 << BITS) - 1
#: Trees across shards, each over its share of the bits.
TREES = 3
#: Fingerprints aimed at in a shard, and in a leaf of the tree inside a shard.
SHARD, LEAF = 4096, 48
#: Fingerprints that shape the trees across shards at most, and the fewest of them in a shard; vantage points tried for a node.
SAMPLE, LEAST, TRIED = 1 << 16, 8, 6
#: Shingles whose bits are counted at once.
CHUNK = 1 << 16


def fingerprint(text: str, width: int = 4, seed: int = 42) -> int:
    """Bit k is set if it is set in over half the hashes of the text's word shingles, repeats included."""
    words = text.encode().lower().split()
    if not words:
        return 0
    size = xxhash.xxh64_intdigest
    if len(words) <= width:
        return size(b" ".join(words), seed)
    n = len(words) - width + 1
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    stops = ends[width - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        hashes = np.fromiter((size(joined[a:z], seed) for a, z in zip(starts[at : at + CHUNK], stops[at : at + CHUNK], strict=True)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for b in batches:
            found = np.fromiter((fingerprint(t, width) for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return common.map_rows(common.texts_of(docs), ["doc_id", "text"], "doc_id long, fp long", run)


#: Odd multipliers that make further hashes of a shingle's hash, one for each 64 bits of a wide fingerprint after the first.
_MORE = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
WIDE = BITS * (1 + len(_MORE))


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """WIDE bits as uint64 words, from the hashes of a set of shingles: a bit is set if it is set in over half of them."""
    counts = np.zeros(WIDE, np.int64)
    for at in range(0, len(hashes), CHUNK):
        h = hashes[at : at + CHUNK].view(np.uint64)
        mixed = [h, *((h ^ h >> np.uint64(29)) * m for m in _MORE)]
        words = np.stack([mixed[0], *(m ^ m >> np.uint64(32) for m in mixed[1:])], axis=1)
        counts += np.unpackbits(words.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)


class VPTree:
    """Vantage-point tree over distinct uint64 fingerprints under the Hamming distance."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.leaf = points, leaf
        self.nodes: list[tuple] = []  # (vantage, median, inside, outside) or (ids,)
        self.root = self._build(np.arange(len(points)))

    def _build(self, ids: np.ndarray) -> int:
        slot = len(self.nodes)
        self.nodes.append((ids,))
        if len(ids) > self.leaf:
            vantage = self.points[ids[len(ids) // 2]]
            d = np.bitwise_count(self.points[ids] ^ vantage)
            mid = int(np.median(d))
            inside, outside = ids[d <= mid], ids[d > mid]
            if len(inside) and len(outside):
                self.nodes[slot] = vantage, mid, self._build(inside), self._build(outside)
        return slot

    def pairs(self, radius: int, queries: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions i, j of points within the radius, each pair once. queries: more points, numbered after the tree's, that are
        paired with the tree's points and not with each other."""
        n = len(self.points)
        every = self.points if queries is None else np.concatenate((self.points, queries))
        work = [(self.root, np.arange(len(every)))]
        while work:
            slot, asked = work.pop()
            node = self.nodes[slot]
            if len(node) == 1:
                ids = node[0]
                step = max(1, (1 << 20) // len(ids))
                for at in range(0, len(asked), step):
                    q = asked[at : at + step]
                    close = (np.bitwise_count(every[q][:, None] ^ self.points[ids][None, :]) <= radius) & ((q[:, None] < ids[None, :]) | (q[:, None] >= n))
                    i, j = np.nonzero(close)
                    if len(i):
                        yield q[i], ids[j]
                continue
            vantage, mid, inside, outside = node
            d = np.bitwise_count(every[asked] ^ vantage).astype(np.int16)
            for child, meets in ((inside, d - radius <= mid), (outside, d + radius > mid)):
                if len(q := asked[meets]):
                    work.append((child, q))


def forest(points: np.ndarray, radius: int, queries: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges of stars that connect what chains of links within the radius connect: links between points, or of a query and a point."""
    if queries is None:
        queries = points[:0]
    every = np.concatenate((points, queries))
    if not len(points) or len(every) < 2:
        return points[:0], points[:0]
    root = np.arange(len(every))
    for i, j in VPTree(points).pairs(radius, queries):
        while True:
            while (root[root] != root).any():
                root = root[root]
            a, b = root[i], root[j]
            if (a == b).all():
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
    while (root[root] != root).any():
        root = root[root]
    moved = root != np.arange(len(every))
    return every[root[moved]], every[moved]


def blocks(free: int, parts: int) -> list[int]:
    """Masks of `parts` disjoint blocks that make up the set bits of free."""
    bits = [1 << k for k in range(BITS) if free >> k & 1]
    cut = [len(bits) * k // parts for k in range(parts + 1)]
    return [sum(bits[a:z]) for a, z in zip(cut, cut[1:], strict=False)]


def masked_distance(points: np.ndarray, vantage: np.uint64, mask: int) -> np.ndarray:
    return np.bitwise_count((points ^ vantage) & np.uint64(mask)).astype(np.int16)


class Shards:
    """Vantage-point trees whose leaves are shards, shaped by a sample; `dealt` says where each fingerprint goes."""

    def __init__(self, sample: np.ndarray, radius: int, least: int, trees: int = TREES):
        self.radius, self.least, self.count = radius, least, 0
        self.rng = np.random.default_rng(0)
        self.trees = [self._build(np.unique(sample), mask, radius // trees) for mask in blocks(ALL, trees)]

    def _build(self, points: np.ndarray, mask: int, radius: int) -> tuple:
        """(mask, radius, vantage, threshold, inside, outside), or (number,) for a leaf."""
        if len(points) > self.least:
            for m, r in dict.fromkeys(((mask, radius), (ALL, self.radius))):
                if (cut := self._cut(points, m, r)) is not None:
                    vantage, mid = cut
                    near = masked_distance(points, vantage, m) <= mid
                    return m, r, vantage, mid, self._build(points[near], mask, radius), self._build(points[~near], mask, radius)
        self.count += 1
        return (self.count - 1,)

    def _cut(self, points: np.ndarray, mask: int, radius: int) -> tuple[np.uint64, int] | None:
        """The vantage point and threshold, with a fifth of the points on either side, whose boundary the fewest balls cross."""
        best = None
        for vantage in self.rng.choice(points, min(TRIED, len(points)), replace=False):
            held = np.cumsum(np.bincount(masked_distance(points, vantage, mask), minlength=BITS + 1))
            for mid in range(BITS):
                if min(held[mid], len(points) - held[mid]) * 5 >= len(points):
                    crossing = held[min(mid + radius, BITS)] - (held[mid - radius] if mid >= radius else 0)
                    if best is None or crossing < best[0]:
                        best = crossing, vantage, mid
        return None if best is None else best[1:]

    def dealt(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """shard, position, whether it is at home there.

        Of two partners that a threshold parts, the outer one crosses as a query; a query goes to every side that can hold its partner."""
        out = []
        work = [(t, np.arange(len(points)), np.ones(len(points), bool)) for t in self.trees]
        while work:
            node, ids, home = work.pop()
            if not len(ids):
                continue
            if len(node) == 1:
                out.append((np.full(len(ids), node[0], np.int64), ids, home))
                continue
            mask, r, vantage, mid, inside, outside = node
            d = masked_distance(points[ids], vantage, mask)
            near, far = d - r <= mid, np.where(home, d, d + r) > mid
            work += ((inside, ids[near], home[near] & (d[near] <= mid)), (outside, ids[far], home[far]))
        return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))


def shards_of(fps: DataFrame, radius: int, shard: int = SHARD) -> Shards:
    n = fps.count()
    sample = fps.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    return Shards(sample.view(np.uint64), radius, max(LEAST, shard * len(sample) // max(n, 1)))


def links(fps: DataFrame, radius: int = 4, shard: int = SHARD) -> DataFrame:
    """u, v: edges whose components are those of all pairs of the distinct `fp` within the radius. fps: a written table."""
    parts = common.shuffle_parts(fps.sparkSession)
    common.ship(fps.sparkSession)
    shards = shards_of(fps, radius, shard)

    def deal(batches):
        for b in batches:
            points = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at, ids, home = shards.dealt(points)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(points[ids].view(np.int64)), pa.array(home)], names=["shard", "fp", "home"])

    def search(batches):
        def ended(held):
            if held:
                points, home = (np.concatenate(c) for c in zip(*held, strict=True))
                u, v = forest(np.sort(points[home]), radius, points[~home])
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        now, held = None, []
        for b in batches:
            at, points, home = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            cuts = np.flatnonzero(np.diff(at)) + 1
            for k, p, h in zip(at[np.concatenate(([0], cuts))].tolist() if len(at) else (), np.split(points.view(np.uint64), cuts), np.split(home.astype(bool), cuts), strict=False):
                if k != now:
                    yield from ended(held)
                    now, held = k, []
                held.append((p, h))
        yield from ended(held)

    spread = fps.select("fp").mapInArrow(deal, "shard long, fp long, home boolean")
    return spread.repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(search, "u long, v long")


def near_groups(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, component_id: one row for each row of docs."""
    marks = common.materialise(fingerprints(docs, width), "fingerprints")
    fps = common.materialise(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows")), "fps")
    labels = components(links(fps.select("fp"), radius)).withColumnRenamed("node", "fp")
    members = common.materialise(labels.join(fps.select("fp", "first_id"), "fp"), "members")
    least = members.groupBy("root").agg(F.min("first_id").alias("component_id"))
    linked = join_on_hot(members.select("fp", "root"), least, "root", "fp").select("fp", "component_id")
    named = fps.join(linked, "fp", "left").select("fp", "rows", F.coalesce("component_id", "first_id").alias("component_id"))
    return join_on_hot(marks, common.materialise(named, "named"), "fp", "doc_id", rows="rows").select("doc_id", "fp", "component_id")


def drop_near(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """docs with one row, that of the smallest doc_id (null last), of each component; each row is decided by a key of its own."""
    rows, key = common.keyed(docs)
    found = near_groups(rows.select(F.col(key).alias("doc_id"), "text"), width, radius)
    return common.without(rows, key, common.later_of_each(rows, key, found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("root"))), docs)


def hex64(column: str):
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable] = {"op6_simhash": op6_simhash}
SQL: dict[str, str] = {}
