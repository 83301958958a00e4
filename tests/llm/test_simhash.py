import random
import re

import numpy as np
import xxhash

from quadrille.llm import simhash
from quadrille.llm.graph import components


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows: (id, fingerprint)."""
    label = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for a, x in rows:
            for b, y in rows:
                if (x ^ y).bit_count() <= 4 and label[a] > label[b]:
                    label[a], changed = label[b], True
    return label


def test_fingerprint():
    for text in ["", None, " \n", "One", "a b c", "a b c d", "A b C d e f É g a b c d", "x " * 500, "p q\x1fr s\xa0t u v w"]:
        assert simhash.fingerprint(text or "") == brute_fingerprint(text)


def test_long_text_in_chunks(monkeypatch):
    text = " ".join(str(i % 97) for i in range(1000))
    monkeypatch.setattr(simhash, "CHUNK", 64)
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def clustered(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 9])):
            out.add(x)
            for _ in range(rng.randrange(1, 6)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)[:n]


def test_tree_finds_all_pairs():
    points = np.array(clustered(700, 1), np.uint64)
    got = {(int(a), int(b)) for i, j in simhash.VPTree(points, leaf=8).pairs(4) for a, b in zip(i, j, strict=True)}
    want = {(i, j) for i in range(len(points)) for j in range(i + 1, len(points)) if (int(points[i]) ^ int(points[j])).bit_count() <= 4}
    assert got == want and want


def test_blocks_cover_the_bits():
    for parts in (1, 5, 7):
        masks = simhash.blocks((1 << 64) - 1, parts)
        assert len(masks) == parts and sum(masks) == (1 << 64) - 1


def test_links_with_and_without_division(spark):
    points = clustered(600, 2) + [(1 << 20 | i) for i in range(40)]
    points = sorted(set(points))
    want = brute_components([(p - (1 << 64) if p >> 63 else p, p) for p in points])
    fps = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in points], "fp long")
    for shard in (4096, 5):
        roots = {r.node: r.root for r in components(simhash.links(fps, 4, shard)).collect()}
        groups = {}
        for p in want:
            groups.setdefault(roots.get(p, p), set()).add(want[p])
        assert all(len(g) == 1 for g in groups.values()) and len(groups) == len(set(want.values()))


def test_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(300)] + [(5, 5), (2000, 2001), (2001, 2000), (-1, -9)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[1000 + i] for i in range(300)}) == 1 and len(set(got.values())) == 4
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_rows(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(9, text), (4, text), (4, text), (7, None), (8, " "), (None, text), (1, "q r s t u v"), (30, text.replace("w299", "x")), (None, "lonely words of their own here")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = simhash.near_groups(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.component_id for r in got if r.doc_id is not None}
    assert by[9] == by[4] == 4 and by[7] == by[8] == 7 and by[1] == 1
    assert (by[30] == 4) == ((brute_fingerprint(text) ^ brute_fingerprint(rows[7][1])).bit_count() <= 4)
    assert simhash.near_groups(docs.limit(0)).count() == 0
    left = simhash.drop_near(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} >= {4, 7, 1, None}


def test_drop_decides_each_row(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(3, text), (5, text), (5, "q r s t u v"), (3, text), (None, "lonely words of their own"), (None, "lonely words of their own")]
    left = simhash.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, left), key=str) == sorted([(3, text), (5, "q r s t u v"), (None, rows[4][1])], key=str)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    rows = [(d.doc_id, brute_fingerprint(d.text)) for d in docs]
    want = brute_components(rows)
    got = {r.doc_id: r for r in simhash.op6_simhash(spark, sf_dir).collect()}
    assert {i: (f"{x:016x}", want[i]) for i, x in rows} == {i: (r.fingerprint, r.component_id) for i, r in got.items()}
