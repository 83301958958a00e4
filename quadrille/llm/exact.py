"""Exact duplicates by an extendible-hash index on shared files.

Texts are equal when they are identical after white space is deleted. Each task first groups the equal texts
of a batch, so a text crosses the network once per batch however often it repeats. The distinct ones are dealt
by key range to owner tasks. An owner inserts them into an extendible-hash index whose buckets are page files in the
shared folder: a bucket that outgrows its capacity is split by one more bit of the key, and the directory
doubles when that bit is new to it. Then the owner reads bucket by bucket, chains the entries of one key, and
compares their bytes, so that colliding keys stay apart. Entries hold the number of rows, the best row and
no member lists, and rows find their group by the entry's id. Keys that hold more than a thousandth of all entries (so at most
a thousand of them) are dealt to SALTS tasks first, which merge the equal texts among theirs: an owner gets at most SALTS entries of such a text.

Rows: null text counts as empty, and empty texts form a group like any other. Of equal texts the row with the
most code points, then the smallest doc_id (null last) stays; of rows that repeat this too, one. One row comes
back for each row of the input.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.ipc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import common, files
from quadrille.llm.graph import HOT, SALTS, join_on_hot

#: Bytes of entries above which a bucket is split, and bytes that an owner holds back before it writes a page.
BUCKET = 32 << 20
PAGE = 2 << 20

_WHITE = b" \t\n\x0b\x0c\r"
_ENTRY = pa.schema([("key", pa.int64()), ("entry", pa.int64()), ("rows", pa.int64()), ("best_len", pa.int64()), ("best_id", pa.int64()), ("body", pa.binary())])


class Bucket:
    __slots__ = ("depth", "held", "held_bytes", "keys", "pages", "size")

    def __init__(self, depth: int):
        self.depth, self.size, self.held_bytes = depth, 0, 0
        self.held: list[tuple] = []
        self.pages: list[str] = []
        self.keys: set[int] = set()  # two different keys at most: enough to tell whether a split can help


class ExtendibleIndex:
    """Buckets of entries (tuples that begin with a 64-bit key and end with a body), kept in page files below a folder."""

    def __init__(self, folder: str, bucket: int = BUCKET, page: int = PAGE):
        self.folder, self.capacity, self.page = folder, bucket, page
        self.depth = 0
        self.directory = [Bucket(0)]

    def insert(self, entry: tuple) -> None:
        key = entry[0]
        self._put(self.directory[key & ((1 << self.depth) - 1)], entry)
        while True:
            b = self.directory[key & ((1 << self.depth) - 1)]
            if b.size <= self.capacity or len(b.keys) < 2 or b.depth >= 63:
                return
            self._split(b, key)

    def _put(self, b: Bucket, entry: tuple) -> None:
        size = len(entry[-1]) + 64
        b.held.append(entry)
        b.held_bytes += size
        b.size += size
        if len(b.keys) < 2:
            b.keys.add(entry[0])
        if b.held_bytes >= self.page:
            self._flush(b)

    def _flush(self, b: Bucket) -> None:
        if b.held:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _ENTRY) as out:
                out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*b.held, strict=True), _ENTRY, strict=True)], schema=_ENTRY))
            name = f"{self.folder}/{uuid.uuid4().hex}.page"
            files.write_bytes(name, sink.getvalue())
            b.pages.append(name)
            b.held, b.held_bytes = [], 0

    def entries(self, b: Bucket) -> Iterator[tuple]:
        for name in b.pages:
            with pa.ipc.open_stream(files.read_bytes(name)) as f:
                for batch in f:
                    yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)
        yield from b.held

    def _split(self, b: Bucket, key: int) -> None:
        if b.depth == self.depth:
            self.directory += self.directory  # doubling: the new bit is the highest of the index
            self.depth += 1
        bit = 1 << b.depth
        low, high = Bucket(b.depth + 1), Bucket(b.depth + 1)
        for slot in range(key & (bit - 1), 1 << self.depth, bit):
            self.directory[slot] = high if slot & bit else low
        for entry in self.entries(b):
            self._put(high if entry[0] & bit else low, entry)
        for name in b.pages:
            files.delete(name)

    def buckets(self) -> Iterator[Bucket]:
        """Each bucket once, with all its entries in page files."""
        for slot, b in enumerate(self.directory):
            if slot < 1 << b.depth:
                self._flush(b)
                yield b


def best(entry: tuple) -> tuple:
    """Sort key of an entry's best row: longest text, then smallest id, null last."""
    return -entry[3], entry[4] is None, entry[4] or 0, entry[1]


def linked(entries: Iterator[tuple], plain: Callable[[bytes], bytes]) -> Iterator[tuple[bytes, tuple, int, list[int]]]:
    """Body, best entry, rows and entry ids of each group of equal texts; one text is held for each group."""
    chains: dict[int, list[list]] = {}
    for e in entries:
        chain = chains.setdefault(e[0], [])
        for group in chain:
            if group[0] == e[5] or plain(group[0]) == plain(e[5]):
                break
        else:
            group = [e[5], e, 0, []]
            chain.append(group)
        group[1] = min(group[1], e, key=best)
        group[2] += e[2]
        group[3].append(e[1])
    for chain in chains.values():
        yield from map(tuple, chain)


def chained(entries: Iterator[tuple], plain: Callable[[bytes], bytes]) -> Iterator[tuple[int, int, int | None, int]]:
    """entry, keeping entry, keeping doc_id and rows of the group for each entry."""
    for _, top, rows, members in linked(entries, plain):
        for entry in members:
            yield entry, top[1], top[4], rows


def _hash(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def entries_of(docs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: its entry, digest, whether it is the entry's best row; the first row of an entry holds the entry.

    keys: columns of longs that are passed on."""
    names = [*keys, "doc_id", "entry", "best_row", "text_sha256", "key", "rows", "best_len", "best_id", "body"]

    def run(batches):
        made = TaskContext.get().partitionId() << 40
        pack = zstandard.ZstdCompressor(level=1, write_content_size=True).compress
        for b in batches:
            ids = b.column(0).to_pylist()
            first: dict[bytes, int] = {}
            tops: dict[int, int] = {}
            lens, at, counts = [], [], {}
            for i, text in enumerate(b.column(1).to_pylist()):
                norm = text.encode().translate(None, _WHITE)
                lens.append(len(text))
                k = first.setdefault(norm, i)
                at.append(k)
                counts[k] = counts.get(k, 0) + 1
                t = tops.setdefault(k, i)
                if (-lens[i], ids[i] is None, ids[i] or 0) < (-lens[t], ids[t] is None, ids[t] or 0):
                    tops[k] = i
            text_of = {k: norm for norm, k in first.items()}
            sha = {k: hashlib.sha256(norm).hexdigest() for k, norm in text_of.items()}
            uid = {k: made + n for n, k in enumerate(text_of)}
            made += len(uid)
            heads = [k if k == i else None for i, k in enumerate(at)]
            columns = [
                b.column(0),
                pa.array([uid[k] for k in at], pa.int64()),
                pa.array([tops[k] == i for i, k in enumerate(at)], pa.bool_()),
                pa.array([sha[k] for k in at], pa.string()),
                pa.array([None if k is None else _hash(text_of[k]) for k in heads], pa.int64()),
                pa.array([None if k is None else counts[k] for k in heads], pa.int64()),
                pa.array([None if k is None else lens[tops[k]] for k in heads], pa.int64()),
                pa.array([None if k is None else ids[tops[k]] for k in heads], pa.int64()),
                pa.array([None if k is None else pack(text_of[k]) for k in heads], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *columns], names=names)

    schema = "".join(f"{k} long, " for k in keys) + "doc_id long, entry long, best_row boolean, text_sha256 string, key long, rows long, best_len long, best_id long, body binary"
    return common.map_rows(common.texts_of(docs, keys), ["doc_id", "text", *keys], schema, run)


def merged(heads: DataFrame) -> DataFrame:
    """entry, into, and on the row where both are equal the merged entry: equal texts among those that a key and salt bring to a task."""
    names = ["into", *_ENTRY.names]

    def run(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        entries = (e for b in batches for e in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for body, top, rows, members in linked(entries, unpack):
            whole = [(top[1], top[0], top[1], rows, top[3], top[4], body)]
            whole += [(top[1], top[0], entry, 0, 0, None, None) for entry in members if entry != top[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "body" else pa.int64()) for n, c in zip(names, zip(*whole, strict=True), strict=True)], names=names)

    salted = heads.withColumn("salt", F.pmod(F.xxhash64("entry"), F.lit(SALTS)))
    spread = salted.repartition(common.shuffle_parts(heads.sparkSession), "key", "salt").select(*_ENTRY.names)
    return spread.mapInArrow(run, "into long, key long, entry long, rows long, best_len long, best_id long, body binary")


def groups_of(entries: DataFrame, bucket: int = BUCKET, page: int = PAGE) -> DataFrame:
    """entry, keep_entry, keep_id, group_size: owner tasks index their key ranges. entries: a written table."""
    heads = entries.filter(F.col("key").isNotNull()).select(*_ENTRY.names)
    n = heads.count()
    hot = [r["key"] for r in heads.groupBy("key").count().filter((F.col("count") * HOT > n) & (F.col("count") > SALTS)).select("key").collect()]
    if not hot:
        return indexed(heads, bucket, page)
    is_hot = F.col("key").isin(hot)
    fewer = common.materialise(merged(heads.filter(is_hot)), "merged")
    groups = common.materialise(indexed(heads.filter(~is_hot).union(fewer.filter("entry = into").select(*_ENTRY.names)), bucket, page), "found")
    others = join_on_hot(fewer.filter("entry <> into").select("into", F.col("entry").alias("member")), groups.withColumnRenamed("entry", "into"), "into", "member")
    return groups.union(others.select(F.col("member").alias("entry"), "keep_entry", "keep_id", "group_size"))


def indexed(heads: DataFrame, bucket: int, page: int) -> DataFrame:
    spark = heads.sparkSession
    folder = common.scratch_path(spark, "index")
    parts = common.shuffle_parts(spark)

    def own(batches):
        index = ExtendibleIndex(f"{folder}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}", bucket, page)
        for b in batches:
            for entry in zip(*(c.to_pylist() for c in b.columns), strict=True):
                index.insert(entry)
        unpack = zstandard.ZstdDecompressor().decompress
        for b in index.buckets():
            rows = list(chained(index.entries(b), unpack))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["entry", "keep_entry", "keep_id", "group_size"])

    # one range of the top bits of the key for each owner; hashes fill them evenly
    ranged = heads.withColumn("owner", F.expr(f"cast(floor((shiftright(key, 32) + 2147483648D) / 4294967296D * {parts}) as int)"))
    return common.by_id(ranged, parts, "owner").select(*_ENTRY.names).mapInArrow(own, "entry long, keep_entry long, keep_id long, group_size long")


def exact_groups(docs: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    entries = common.materialise(entries_of(docs, keys), "entries")
    groups = common.materialise(groups_of(entries), "groups")
    return (
        entries.select(*keys, "doc_id", "entry", "best_row", "text_sha256")
        .join(groups, "entry")
        .select(*keys, "doc_id", "keep_id", "group_size", (F.col("best_row") & (F.col("entry") == F.col("keep_entry"))).alias("kept"), "text_sha256")
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """docs without the rows whose text another row keeps, decided for each row by a key of its own."""
    rows, key = common.keyed(docs)
    given = rows.select("doc_id", "text", F.col(key).alias("row"))
    return common.without(rows, key, exact_groups(given, ("row",)).filter("not kept").select("row"), docs)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable] = {"op4_exact_dedup": op4_exact_dedup}
SQL: dict[str, str] = {
    "op4_exact_dedup": r"""
    with d as (select doc_id, coalesce(text, '') as t from documents),
    n as (select doc_id, length(t) as len, regexp_replace(t, '[\x20\x09-\x0D]', '', 'g') as norm from d)
    select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by norm) as group_size,
           doc_id = first_value(doc_id) over w as kept, sha256(norm) as text_sha256
    from n window w as (partition by norm order by len desc, doc_id)
    """
}
