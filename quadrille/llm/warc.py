"""WARC archives: a writer with one gzip member per record, and a splittable reader.

The writer turns rows into records (response, or revisit where another record holds an equal payload) and writes
one archive per task into the shared folder. Each attempt of a task writes a file of its own name and the manifest
lists only those of the attempts that counted, so lost executors leave nothing double.

The reader needs no index. Tasks get byte ranges; each scans its range for the gzip magic and takes a candidate for a
member only if its first bytes inflate to a WARC header, the whole member decodes, and it is followed by the end of the file or by
another such member; where it is not (the next one is damaged, or the candidate stands inside a stored record), the
nearest member before it must end at or before it. From there it walks member by member. A task owns the records that start inside its range and reads
past its end to finish the last one. Damaged members are left out, whatever the ranges.

Rows: null html counts as empty. Payloads below 1000 bytes are never revisits. Of equal payloads (SHA-256 of the
bytes) the largest page_id is the response; rows that repeat that id are responses too. Rows with a null page_id
are written and read like others; a group of null ids only is all responses.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import common, files
from quadrille.llm.graph import join_on_hot

MAGIC = b"\x1f\x8b\x08"
#: Payload bytes from which equal payloads are stored once.
LEAST = 1000
#: Bytes of an archive that one task scans, and bytes that it reads at once.
RANGE, READ = 8 << 20, 1 << 20
_HEAD = 8192


def record_id(page_id: int | None, salt: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{salt}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with the payload, or a revisit with the HTTP header only."""
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = "".join(c for c in url or "" if c.isprintable())
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, sha1)}", f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{sha1}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, sha1)}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


class Window:
    """Random access to a file through a buffer that grows forward and is cut behind."""

    def __init__(self, f, size: int, at: int):
        self.f, self.size, self.base, self.data = f, size, at, b""

    def ensure(self, upto: int) -> None:
        end = self.base + len(self.data)
        if upto > end and end < self.size:
            self.f.seek(end)
            more = self.f.read(min(max(upto - end, READ), self.size - end))
            if not more:
                raise EOFError(f"the file ends at {end}, not at {self.size}")
            self.data += more

    def cut(self, at: int) -> None:
        if at - self.base > READ:
            self.data, self.base = self.data[at - self.base :], at

    def get(self, a: int, z: int) -> bytes:
        self.ensure(z)
        return self.data[a - self.base : max(z - self.base, 0)]


def header_at(w: Window, at: int) -> bool:
    """Whether a gzip member whose content begins like a WARC record starts here."""
    piece = w.get(at, at + _HEAD)
    if not piece.startswith(MAGIC):
        return False
    try:
        return zlib.decompressobj(31).decompress(piece, 5) == b"WARC/"
    except zlib.error:
        return False


def member(w: Window, at: int) -> tuple[bytes, int] | None:
    """Content and end of the member at this position; None if it does not decode to its end."""
    unpack, parts, pos = zlib.decompressobj(31), [], at
    try:
        while not unpack.eof:
            piece = w.get(pos, pos + 65536)
            if not piece:
                return None
            parts.append(unpack.decompress(piece))
            pos += len(piece) - len(unpack.unused_data)
    except zlib.error:
        return None
    return b"".join(parts), pos


def stands_alone(f, size: int, at: int) -> bool:
    """Whether the nearest member that starts before this place does not reach beyond it."""
    end = at
    while end > 0:
        start = max(0, end - READ)
        f.seek(start)
        piece = f.read(min(end + 2, at + 2) - start)
        k = piece.rfind(MAGIC, 0, end - start + 2)
        while k >= 0:
            w = Window(f, size, start + k)
            if start + k < at and header_at(w, start + k) and (found := member(w, start + k)):
                return found[1] <= at
            k = piece.rfind(MAGIC, 0, k + 2)
        end = start
    return True


def members(f, size: int, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    """Offset and content of the WARC members that start in [start, stop)."""
    w, at, sure = Window(f, size, start), start, False
    while at < stop:
        if not sure:
            w.ensure(min(at + READ, stop + 2))
            hit = w.data.find(MAGIC, at - w.base)
            end = w.base + len(w.data)
            if hit < 0:
                at = max(at, end - 2)
                if end >= min(stop + 2, size):
                    return
                w.cut(at)
                continue
            at = w.base + hit
            if at >= stop:
                return
        found = member(w, at) if header_at(w, at) else None
        if found is None or not sure and at and found[1] < size and not header_at(w, found[1]) and not stands_alone(f, size, at):
            at, sure = at + 1, False
            continue
        yield at, found[0]
        at, sure = found[1], True
        w.cut(at)


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode(errors="replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest[: int(fields.get("content-length", len(rest)))]


def _whole(text: str | bytes | None) -> int | None:
    try:
        return int(text) if text is not None else None
    except ValueError:
        return None


def described(content: bytes) -> tuple[int | None, int | None, str | None, str, int | None, str | None, bytes | None]:
    """page_id, payload bytes, digest, type, refers_to, url and (responses) payload of a record; null where a foreign record says nothing."""
    fields, block = parse(content)
    page = _whole(fields.get("x-page-id"))
    kind, url = fields.get("warc-type", "unknown"), fields.get("warc-target-uri")
    http, _, payload = block.partition(b"\r\n\r\n")
    if kind == "revisit":
        length = next((_whole(line.split(b":")[1].strip()) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")), None)
        name, _, said = fields.get("warc-payload-digest", "").partition(":")
        try:
            digest = base64.b32decode(said).hex() if name.lower() == "sha1" else None
        except ValueError:
            digest = None
        return page, length, digest, kind, _whole(fields.get("x-refers-to-page-id")), url, None
    return page, len(payload), hashlib.sha1(payload).hexdigest(), kind, None, url, payload


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    # pages that are too short to be shared get a key that no other page has
    keyed = rows.withColumn("k", F.when(F.octet_length("payload") >= LEAST, F.sha2("payload", 256)).otherwise(F.concat(F.lit("-"), F.hex(F.xxhash64("page_id", "url", "payload")))))
    shared = common.materialise(keyed.filter("k not like '-%'").groupBy("k").agg(F.max("page_id").alias("top"), F.count("*").alias("n")).filter("n > 1 and top is not null"), "shared")
    joined = join_on_hot(keyed, shared, "k", "page_id", "left", rows="n")
    return joined.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("top")), F.col("top")).alias("refers_to"))


def write_archives(records: DataFrame) -> DataFrame:
    """Write page_id, url, payload, refers_to as archives; path, bytes and records of each archive."""
    spark = records.sparkSession
    folder = common.scratch_path(spark, "warc")

    def run(batches):
        uri = f"{folder}/{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        store = out = None
        size = n = 0
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if out is None:
                    store, path = files.opened(uri)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(path, compression=None)  # the name would have it compressed again
                data = record(*row)
                out.write(data)
                size, n = size + len(data), n + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size], pa.int64()), pa.array([n], pa.int64())], names=["path", "bytes", "records"])

    wanted = common.map_rows(records, ["page_id", "url", "payload", "refers_to"], "path string, bytes long, records long", run)
    return common.materialise(wanted, "manifest")


def read_archives(archives: DataFrame, with_payload: bool = False, range_bytes: int = RANGE) -> DataFrame:
    """The records of archives (path, bytes), read in byte ranges."""
    spark = archives.sparkSession
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"][: 7 if with_payload else 5]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches):
        for b in batches:
            for path, size, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, local = files.opened(path)
                rows: list[tuple] = []
                held = 0

                def batch(rows):
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True))[: len(names)], kinds, strict=False)], names=names)

                with store.open_input_file(local) as f:
                    for _, content in members(f, size, start, min(size, start + range_bytes)):
                        rows.append(described(content) if with_payload else (*described(content)[:5],))
                        held += len(content) if with_payload else 100
                        if held > 4 << 20:
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * with_payload
    ranges = archives.filter("bytes > 0").select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    return common.map_rows(ranges.repartition(common.shuffle_parts(spark)), ["path", "bytes", "start"], schema, run)


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """path and bytes of the archives below a folder, listed by Spark."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", F.col("length").alias("bytes"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(plan_records(common.table(spark, sf_dir, "pages"))))


QUERIES: dict[str, Callable] = {"op3_warc": op3_warc}
SQL: dict[str, str] = {
    "op3_warc": """
    with p as (select page_id, coalesce(html, '') as h from pages),
    t as (select *, max(page_id) over (partition by h) as top from p)
    select page_id, strlen(h) as payload_bytes, sha1(h) as payload_digest,
           case when strlen(h) >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
           case when strlen(h) >= 1000 and page_id <> top then top end as refers_to
    from t
    """
}
