"""Substring dedup: words inside windows that also start earlier, found through difference-cover anchors.

A difference cover D modulo v holds, for any two positions, a common shift k < v that brings both into D. So if two windows of
WINDOW words are equal, some anchor of WINDOW - v + 1 words inside them starts at a cover position in both texts.
Only anchors at cover positions (4 of 13) are hashed and compared across the corpus. Anchors that occur twice are
extended: the windows that hold one are hashed in full (96 bits and the bucket), and a window is removed where an
equal one starts earlier. Words are compared by these hashes.

Every comparison is first made inside the batch that a task holds; only one occurrence of a hash goes out per batch,
so that a passage in very many documents costs its owner one entry per batch. Entries travel as packed arrays.

Rows: null and empty texts have no words. doc_id orders documents, null last; rows of one doc_id are read as the same
document and do not come before each other. Windows of texts shorter than WINDOW words do not exist, so nothing is
removed from them. Each row of the input gives one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import common

WINDOW = 20
#: A difference cover: the differences of its members give every residue modulo PERIOD.
PERIOD, COVER = 13, (0, 1, 3, 9)
ANCHOR = WINDOW - PERIOD + 1
#: Bytes of a hash that travel, for anchors (a filter) and windows (the decision).
ANCHOR_BYTES, WINDOW_BYTES = 6, 12
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_LAST = np.iinfo(np.int64).max  # stands for a null doc_id
#: Entries that a task compares before it sends them on.
HOLD = 2_000_000
_ROW = "b int, kind int, payload binary"


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, starts: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hashes of the windows of word hashes that begin at starts."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(width):
        out = out * _BASES[base] + h[starts + k]
    return (out ^ out >> np.uint64(31)) * _BASES[1 - base]


def doc_bucket(docs: np.ndarray, n: int) -> np.ndarray:
    u = docs.view(np.uint64)
    return (u ^ u >> np.uint64(15) ^ u >> np.uint64(31)).view(np.int64) % n


def doc_bucket_column(doc_id, n: int):
    d = F.coalesce(doc_id, F.lit(_LAST))
    return F.pmod(d.bitwiseXOR(F.shiftrightunsigned(d, 15)).bitwiseXOR(F.shiftrightunsigned(d, 31)), F.lit(n).cast("long")).cast("int")


def pack(hashes: np.ndarray, docs: np.ndarray, at: np.ndarray) -> bytes:
    """Rows of hash bytes, documents and positions; best sorted by document."""
    n = len(docs)
    deltas = np.diff(docs, prepend=np.int64(0)).astype(np.int64)
    planes = deltas.view(np.uint8).reshape(n, 8).T.tobytes() + at.astype(np.int32).view(np.uint8).reshape(n, 4).T.tobytes()
    blob = zstandard.ZstdCompressor(level=1).compress(planes)
    return np.array([n, len(blob), hashes.shape[1]], np.uint32).tobytes() + blob + hashes.tobytes()


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, size, width = (int(x) for x in np.frombuffer(payload, np.uint32, 3))
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload[12 : 12 + size], max_output_size=12 * n), np.uint8)
    docs = np.cumsum(np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view(np.int64).ravel())
    at = np.ascontiguousarray(planes[8 * n :].reshape(4, n).T).view(np.int32).ravel()
    return np.frombuffer(payload, np.uint8, n * width, 12 + size).reshape(n, width), docs, at


def dealt(kind: int, buckets: np.ndarray, hashes: np.ndarray, docs: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, kind, payload) rows, one for each bucket with entries."""
    if not len(docs):
        return
    order = np.lexsort((at, docs, buckets))
    buckets, hashes, docs, at = buckets[order], hashes[order], docs[order], at[order]
    cuts = np.flatnonzero(np.diff(buckets, prepend=-1)).tolist()
    for a, z in zip(cuts, [*cuts[1:], len(buckets)], strict=True):
        yield int(buckets[a]), kind, pack(hashes[a:z], docs[a:z], at[a:z])


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    b, kind, payload = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(kind, pa.int32()), pa.array(payload, pa.binary())], names=["b", "kind", "payload"])


def runs(h: np.ndarray, h2: np.ndarray, docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by (hash, document, position), and for each place in it where its run of equal hashes begins."""
    order = np.lexsort((at, docs, h2, h))
    new = np.concatenate(([True], (np.diff(h[order]) != 0) | (np.diff(h2[order]) != 0)))
    return order, np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))


def later(order: np.ndarray, first: np.ndarray, docs: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether each place comes strictly after the first occurrence of its run."""
    d, p = docs[order], at[order]
    return (d != d[first]) | (p != p[first])


def _local(h: np.ndarray, h2: np.ndarray, docs: np.ndarray, at: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    """Entries that are settled here (every: all that repeat, else those that come later), and one of each hash to send."""
    order, first = runs(h, h2, docs, at)
    late = later(order, first, docs, at)
    if every:
        repeated = np.zeros(len(order), bool)
        repeated[first[late]] = True
        settled = order[repeated[first]]
    else:
        settled = order[late]
    return settled, order[first == np.arange(len(order))]


def _hash_bytes(h: np.ndarray, h2: np.ndarray, width: int) -> np.ndarray:
    both = np.stack((h, h2), axis=1).view(np.uint8).reshape(len(h), 16)
    return np.ascontiguousarray(both[:, :width])


def _from_bytes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    wide = np.zeros((len(raw), 16), np.uint8)
    wide[:, : raw.shape[1]] = raw
    wide = wide.view(np.uint64)
    return wide[:, 0].copy(), wide[:, 1].copy()


def _sent(entries: list[tuple], nb: int, width: int, every: bool) -> pa.RecordBatch:
    """Settle what can be settled within entries (hash, second hash, documents, positions); the rest as rows for owners."""
    h, h2, docs, at = (np.concatenate(c) for c in zip(*entries, strict=True))
    settled, out = _local(h, h2, docs, at, every)
    none = np.empty((len(settled), 0), np.uint8)
    rows = list(dealt(1, doc_bucket(docs[settled], nb), none, docs[settled], at[settled]))
    # the bucket comes from bits that do not travel
    rows += dealt(0, (h[out] >> np.uint64(48)).astype(np.int64) % nb, _hash_bytes(h[out], h2[out], width), docs[out], at[out])
    return _rows(rows)


def _grouped(batches, own: Callable[[int, list], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Call own with the rows of each bucket; the batches are sorted by bucket."""
    now, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[0] != now and held:
                yield from own(now, held)
                held = []
            now = row[0]
            held.append(row[1:])
    if held:
        yield from own(now, held)


def owned(rows: DataFrame, nb: int, every: bool) -> DataFrame:
    """Compare across batches: b (bucket of documents) and payload of settled (document, position) entries."""
    parts = common.shuffle_parts(rows.sparkSession)

    def own(b, held):
        if out := [(b, 0, p) for kind, p in held if kind == 1]:
            yield _rows(out)
        got = [unpack(p) for kind, p in held if kind == 0]
        if got:
            raw, docs, at = (np.concatenate(c) for c in zip(*got, strict=True))
            h, h2 = _from_bytes(raw)
            settled, _ = _local(h, h2, docs, at, every)
            yield _rows(list(dealt(0, doc_bucket(docs[settled], nb), np.empty((len(settled), 0), np.uint8), docs[settled], at[settled])))

    return common.by_id(rows, parts, "b").sortWithinPartitions("b", "kind").mapInArrow(lambda batches: _grouped(batches, own), _ROW)


def anchors(docs: DataFrame, nb: int) -> DataFrame:
    """Anchors at cover positions, those that repeat within a batch settled."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = text.encode().split()
                if len(words) < WINDOW:
                    continue
                h = word_hashes(words)
                starts = np.arange(len(words) - ANCHOR + 1)
                starts = starts[np.isin(starts % PERIOD, COVER)]
                held.append((window_hashes(h, starts, ANCHOR, 0), np.zeros(len(starts), np.uint64), np.full(len(starts), _LAST if doc is None else doc, np.int64), starts.astype(np.int32)))
                n += len(starts)
                if n >= HOLD:
                    yield _sent(held, nb, ANCHOR_BYTES, True)
                    held, n = [], 0
        if held:
            yield _sent(held, nb, ANCHOR_BYTES, True)

    return common.map_rows(docs, ["doc_id", "text"], _ROW, run)


def _positions(held: list) -> dict[int, np.ndarray]:
    """Positions by document, from payloads."""
    if not held:
        return {}
    _, docs, at = (np.concatenate(c) for c in zip(*map(unpack, held), strict=True))
    order = np.argsort(docs, kind="stable")
    docs, at = docs[order], at[order]
    cuts = np.flatnonzero(np.diff(docs)) + 1
    return dict(zip(docs[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True))


def _met(found: DataFrame, docs: DataFrame, fn: Callable, columns: list[str], schema: str) -> DataFrame:
    """fn(positions or None, *columns) for each row of docs, whose bucket b meets the settled entries of that bucket."""
    parts = common.shuffle_parts(docs.sparkSession)
    left = found.select("b", F.lit(0).alias("kind"), "payload", *[F.lit(None).cast(docs.schema[c].dataType).alias(c) for c in columns])
    right = docs.select("b", F.lit(1).alias("kind"), F.lit(None).cast("binary").alias("payload"), *columns)
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    arrow = [{"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}[k] for k in kinds]

    def run(batches):
        now, held, known = None, [], None
        for batch in batches:
            out = []
            for b, kind, payload, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != now:
                    now, held, known = b, [], None
                if kind == 0:
                    held.append(payload)
                    continue
                if known is None:
                    known, held = _positions(held), []
                out.append((b, *fn(known.get(_LAST if row[0] is None else row[0]), *row)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow, strict=True)], names=list(names))

    both = common.by_id(left.unionByName(right), parts, "b").sortWithinPartitions("b", "kind")
    return both.mapInArrow(run, schema)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_JUDGED = "b int, doc_id long, n_words long, kept_sha256 string, words binary, flags binary"


def _judge(flags, doc, text):
    words = text.encode().split()
    if flags is None or len(words) < WINDOW:
        return doc, len(words), _sha(words), None, None
    return doc, len(words), None, zstandard.ZstdCompressor(level=1).compress(b" ".join(words)), np.unique(flags).astype(np.int32).tobytes()


def _open(blob: bytes) -> list[bytes]:
    return zstandard.ZstdDecompressor().decompressobj().decompress(blob).split(b" ")


def windows(judged: DataFrame, nb: int) -> DataFrame:
    """Windows that hold a repeated anchor, those that come later within a batch settled."""

    def run(batches):
        held, n = [], 0
        for b in batches:
            for doc, blob, flags in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = word_hashes(_open(blob))
                hit = np.frombuffer(flags, np.int32)
                hit = hit[hit + ANCHOR <= len(h)]
                starts = np.unique((hit[:, None] - np.arange(PERIOD)[None, :]).ravel())
                starts = starts[(starts >= 0) & (starts <= len(h) - WINDOW)]
                if not len(starts):
                    continue
                held.append((window_hashes(h, starts, WINDOW, 0), window_hashes(h, starts, WINDOW, 1), np.full(len(starts), _LAST if doc is None else doc, np.int64), starts.astype(np.int32)))
                n += len(starts)
                if n >= HOLD:
                    yield _sent(held, nb, WINDOW_BYTES, False)
                    held, n = [], 0
        if held:
            yield _sent(held, nb, WINDOW_BYTES, False)

    return common.map_rows(judged, ["doc_id", "words", "flags"], _ROW, run)


def _removed(starts: np.ndarray | None, n: int) -> np.ndarray:
    """Which of n words a removed window covers."""
    edge = np.zeros(n + 1, np.int64)
    if starts is not None:
        starts = np.unique(starts)
        starts = starts[starts <= n - WINDOW]
        edge[starts] += 1
        edge[starts + WINDOW] -= 1
    return np.cumsum(edge[:n]) > 0


_DONE = "b int, doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"


def _finish(starts, doc, blob):
    words = _open(blob)
    gone = _removed(starts, len(words))
    kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
    return doc, len(words), int(gone.sum()), _sha(kept), b" ".join(kept)


def deduplicated(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of docs; with_text adds the kept words of documents that lost some."""
    spark = docs.sparkSession
    nb = common.shuffle_parts(spark)  # a bucket for each task: more would make small rows, one for each two buckets
    texts = common.texts_of(docs)
    flagged = owned(anchors(texts, nb), nb, True)
    judged = common.materialise(_met(flagged, texts.withColumn("b", doc_bucket_column(F.col("doc_id"), nb)), _judge, ["doc_id", "text"], _JUDGED), "judged")
    still = judged.filter("words is not null")
    late = owned(windows(still, nb), nb, False)
    finished = _met(late, still.select("b", "doc_id", "words"), _finish, ["doc_id", "words"], _DONE).drop("b")
    done = judged.filter("words is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("binary").alias("kept"))
    both = done.unionByName(finished)
    return both.withColumn("kept", F.col("kept").cast("string")) if with_text else both.drop("kept")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable] = {"op5_substring_dedup": op5_substring_dedup}
SQL: dict[str, str] = {}
