import gzip
import hashlib
import io
import zlib

import duckdb
import pytest

from quadrille.llm import warc


def archive(n, size=300):
    data = [warc.record(i, f"http://x/{i}", (f"page {i} " * size)[: size * (i % 7)].encode(), None if i % 3 else i + 1) for i in range(n)]
    return data, b"".join(data)


@pytest.mark.parametrize("step", [1, 37, 500, 4096, 10**7])
def test_each_range_owns_the_records_that_start_in_it(step, monkeypatch):
    monkeypatch.setattr(warc, "READ", 256)
    parts, data = archive(40 if step > 1 else 6)
    starts, at = [], 0
    for p in parts:
        starts.append(at)
        at += len(p)
    got = []
    for a in range(0, len(data), step):
        got += [o for o, _ in warc.members(io.BytesIO(data), len(data), a, min(len(data), a + step))]
    assert got == starts
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == len(parts)


def test_magic_inside_records_is_not_a_record():
    inner = warc.record(99, "http://in", b"inner", None)
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)  # stored, so that the inner bytes stand in the archive as they are
    head = f"WARC/1.1\r\nWARC-Type: response\r\nX-Page-Id: 1\r\nContent-Length: {len(inner) + 9}\r\n\r\n".encode()
    outer = packer.compress(head + b"HTTP\r\n\r\n" + inner + MAGIC_TAIL + b"\r\n\r\n") + packer.flush()
    data = outer + warc.record(2, "u", b"after", None)
    assert inner in data
    for a in range(0, len(data), 11):
        for offset, _ in warc.members(io.BytesIO(data), len(data), a, min(a + 11, len(data))):
            assert offset in (0, len(outer))


def test_damage_costs_the_same_records_for_all_ranges(monkeypatch):
    monkeypatch.setattr(warc, "READ", 256)
    for hurt, at in ((3, 0.5), (3, 0.0), (0, 0.2), (5, 0.9), (4, 0.01)):
        parts, data = archive(6)
        starts = [sum(map(len, parts[:k])) for k in range(6)]
        spot = starts[hurt] + int(len(parts[hurt]) * at)
        broken = data[:spot] + bytes(x ^ 0x5A for x in data[spot : spot + 9]) + data[spot + 9 :]
        for step in (41, 60, 300, 309, 10**7):
            got = [o for a in range(0, len(broken), step) for o, _ in warc.members(io.BytesIO(broken), len(broken), a, min(len(broken), a + step))]
            assert got == [x for k, x in enumerate(starts) if k != hurt]


def test_foreign_records():
    for head in ("WARC-Type: revisit", "WARC-Type: revisit\r\nWARC-Payload-Digest: md5:zz\r\nX-Page-Id: q", "WARC-Type: warcinfo", "X: y", "WARC-Type: revisit\r\nWARC-Payload-Digest: sha1:1"):
        found = warc.described(f"WARC/1.0\r\n{head}\r\nContent-Length: 4\r\n\r\nabcd".encode())
        assert found[0] is None and found[4] is None and len(found) == 7


MAGIC_TAIL = b"\x1f\x8b\x08"


def brute(rows):
    top = {}
    for i, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000 and i is not None:
            top[b] = max(i, top.get(b, i))
    out = []
    for i, h in rows:
        b = (h or "").encode()
        again = b in top and i != top[b]
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top[b] if again else None))
    return sorted(out, key=str)


def test_rows(spark):
    big = "é" * 600
    rows = [(1, big), (7, big), (3, big), (7, big), (4, None), (5, ""), (6, "a" * 999), (8, "a" * 999), (9, "b" * 1000), (10, "b" * 1000), (None, big), (None, None), (11, "\r\n\r\nWARC/1.1\r\n" * 200_000)]
    pages = spark.createDataFrame([(i, f"http://h/{i}\n", h, 0) for i, h in rows], "page_id long, url string, html string, payload int").repartition(3)
    manifest = warc.write_archives(warc.plan_records(pages))
    got = sorted(map(tuple, warc.read_archives(manifest, range_bytes=300).collect()), key=str)
    assert got == brute(rows)
    full = warc.read_archives(manifest, with_payload=True).filter("record_type = 'response'").collect()
    assert {bytes(r.payload).decode() for r in full} == {h or "" for _, h in rows}
    folder = manifest.first().path.rpartition("/")[0]
    assert warc.archives_in(spark, folder).count() == manifest.count()
    assert warc.read_archives(warc.write_archives(warc.plan_records(pages.limit(0)))).count() == 0


def test_query(spark, sf_dir):
    got = sorted(map(tuple, warc.op3_warc(spark, sf_dir).collect()), key=str)
    rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()]
    assert got == brute(rows)
    duckdb.sql(f"create or replace view pages as select * from '{sf_dir}/pages.parquet'")
    assert got == sorted(duckdb.sql(warc.SQL["op3_warc"]).fetchall(), key=str)
