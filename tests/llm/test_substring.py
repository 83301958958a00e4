import hashlib
import random
import re

import numpy as np
import pytest

from quadrille.llm import substring


def brute(rows):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    big = 1 << 63
    for i, w in docs:
        for s in range(len(w) - 19):
            key, at = tuple(w[s : s + 20]), (big if i is None else i, s)
            first[key] = min(first.get(key, at), at)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            if first[tuple(w[s : s + 20])] < (big if i is None else i, s):
                gone[s : s + 20] = [True] * 20
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_cover_meets_every_difference():
    d = substring.COVER
    assert {(a - b) % substring.PERIOD for a in d for b in d} == set(range(substring.PERIOD))


def test_pack_and_buckets():
    docs, at = np.array([-5, 3, 3, 1 << 62], np.int64), np.array([0, 7, 9, 1 << 20], np.int32)
    raw = np.arange(24, dtype=np.uint8).reshape(4, 6)
    for got, want in zip(substring.unpack(substring.pack(raw, docs, at)), (raw, docs, at), strict=True):
        assert (got == want).all()


def made(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(9)]
    text = lambda n: [rng.choice(words) + str(rng.randrange(40)) for _ in range(n)]
    shared = [text(n) for n in (20, 21, 33, 60)]
    rows = []
    for i in rng.sample(range(1000), 40):
        w = []
        for _ in range(rng.randrange(4)):
            w += text(rng.randrange(30)) + rng.choice(shared)[rng.randrange(3) : 60 - rng.randrange(25)]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    rows += [(2000, "same word " * 60), (2001, "x " * 19), (2002, "x " * 20), (2003, "x " * 21), (2004, None), (2005, ""), (2006, "é " * 50_000), (None, rows[0][1]), (None, "x " * 45)]
    return rows


@pytest.mark.parametrize(("seed", "hold"), [(1, 10**7), (2, 50)])
def test_rows(spark, seed, hold, monkeypatch):
    monkeypatch.setattr(substring, "HOLD", hold)
    rows = made(seed)
    docs = spark.createDataFrame([(i, t, 1, b"") for i, t in rows], "doc_id long, text string, b int, payload binary").repartition(5)
    assert sorted(map(tuple, substring.deduplicated(docs).collect()), key=str) == brute(rows)
    assert substring.deduplicated(docs.limit(0)).count() == 0


def test_repeated_rows_and_kept_text(spark):
    text = " ".join(f"q{k}" for k in range(30))
    rows = [(4, text), (4, text), (7, "a b " + text + " c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.deduplicated(docs, with_text=True).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(4, 0), (4, 0), (7, 30)]
    assert [r.kept for r in got if r.doc_id == 7] == ["a b c"]


def test_query(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, substring.op5_substring_dedup(spark, sf_dir).collect()), key=str) == brute(rows)
    assert any(r[2] for r in brute(rows))
