import hashlib
import re
from collections import defaultdict

from quadrille.llm import exact


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", text or "")].append((doc_id, text or ""))
    out = []
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), hashlib.sha256(norm.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=str)


def test_index_splits_doubles_and_chains(tmp_path):
    index = exact.ExtendibleIndex(str(tmp_path), bucket=2000, page=500)
    entries = [((i * 2654435761) % (1 << 40), i, 1, 1, i, b"x" * 20) for i in range(500)]
    entries += [(7, 1000 + i, 1, 1, i, b"same") for i in range(100)] + [(7, 2000 + i, 1, 1, i, b"other") for i in range(50)]
    for e in entries:
        index.insert(e)
    assert index.depth > 2 and len(index.directory) == 1 << index.depth
    found = [e for b in index.buckets() for e in index.entries(b)]
    assert sorted(found) == sorted(entries)
    for b in index.buckets():
        assert len({e[0] & ((1 << b.depth) - 1) for e in index.entries(b)}) <= 1
        assert not b.held
    rows = {e: (keep, n) for b in index.buckets() for e, keep, _, n in exact.chained(index.entries(b), bytes)}
    assert rows[1050] == (1000, 100) and rows[2049] == (2000, 50) and rows[3] == (3, 1)


def test_rows(spark):
    rows = [(5, "a b"), (3, "ab"), (9, "a \t\nb"), (1, None), (2, ""), (4, " "), (None, "ab  "), (6, "x" * 200_000), (7, "x" * 200_000), (8, "ba"), (11, "a b"), (12, "a\xa0b")]
    docs = spark.createDataFrame([(i, t, "z", 1) for i, t in rows], "doc_id long, text string, kept string, key int").repartition(4)
    got = exact.exact_groups(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    assert {r.doc_id for r in got if r.kept} == {9, 4, 6, 8, 12}
    assert exact.exact_groups(docs.limit(0)).count() == 0
    assert {r.doc_id for r in exact.drop_exact(docs).collect()} == {9, 4, 6, 8, 12}
    assert exact.drop_exact(docs).columns == docs.columns


def test_repeated_rows_keep_one(spark):
    docs = spark.createDataFrame([(1, "a")] * 5 + [(2, "a")], "doc_id long, text string").repartition(3)
    got = exact.exact_groups(docs).collect()
    assert sum(r.kept for r in got) == 1 and {(r.keep_id, r.group_size) for r in got} == {(1, 6)}


def test_hot_keys_are_merged_first(spark, monkeypatch):
    """A batch for each row, so that a group has an entry for each of its rows; every hash collides with another text's."""
    monkeypatch.setattr(exact, "SALTS", 3)
    monkeypatch.setattr(exact, "_hash", lambda data: len(data))
    monkeypatch.setattr(exact, "HOT", 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        rows = [(i, "hot text" + " " * (i % 5)) for i in range(40)] + [(100 + i, "xotytext") for i in range(30)] + [(200 + i, f"n {i}") for i in range(9)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = exact.exact_groups(docs).collect()
        assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
        assert sum(r.kept for r in got) == 11
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_drop_decides_each_row(spark):
    rows = [(1, "a b")] * 3 + [(None, "c")] * 2 + [(5, "ab"), (5, "d"), (None, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, exact.drop_exact(docs).collect()), key=str) == sorted([(1, "a b"), (None, "c"), (5, "d")], key=str)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = exact.op4_exact_dedup(spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute([tuple(d) for d in docs])
    assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
