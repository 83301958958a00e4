import random
import re

import pytest

from quadrille.llm import near


def brute_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def brute_kept(rows):
    """rows: (id or None, text). Positions that stay: the first by id, null last, of each component; with the pairs."""
    sets = [brute_set(t) for _, t in rows]
    root, pairs = list(range(len(rows))), 0

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                pairs += 1
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        key = (d is None, d or 0, i)
        best[find(i)] = min(best.get(find(i), key), key)
    return sorted(k[2] for k in best.values()), pairs


def corpus(seed, n=150):
    """Texts with copies that differ by one to many words, and a passage that many of them share."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passage = rng.choices(vocabulary, k=60)
    out = []
    for _ in range(n):
        base = rng.choices(vocabulary, k=rng.choice([3, 12, 40, 120, 400]))
        if rng.random() < 0.5:
            base += passage
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = list(base)
            for _ in range(rng.randrange(1, max(2, len(w) // 20))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w[rng.randrange(3) :]))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("sample", [1, 32])
def test_all_links_of_brute_force(spark, monkeypatch, sample):
    monkeypatch.setattr(near, "SAMPLE", sample)
    rows = list(enumerate(corpus(7)))
    want, pairs = brute_kept(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = near.drop_near(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == want
    assert pairs > 50 and len(want) < len(rows)


def test_copies_beyond_four_bits(spark):
    """A copy of Jaccard 0.8 or more whose SimHash fingerprints differ in over 4 bits goes."""
    from quadrille.llm.simhash import fingerprint

    rng = random.Random(3)
    w = [f"v{rng.randrange(10**6)}" for _ in range(200)]
    copy = list(w)
    for k in (30, 90, 150):
        copy[k] = "changed"
    rows = [(1, " ".join(w)), (2, " ".join(copy))]
    assert similar(brute_set(rows[0][1]), brute_set(rows[1][1]))
    assert (fingerprint(rows[0][1]) ^ fingerprint(rows[1][1])).bit_count() > 4
    assert [r.doc_id for r in near.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [1]


def test_rows(spark):
    a, b = " ".join(f"a{i}" for i in range(300)), "some quite other text of more than five words"
    rows = [(4, a), (4, a), (3, a.replace("a7 ", "x ")), (3, b), (None, None), (None, " "), (8, "One two"), (None, "one  TWO"), (None, "alone"), (None, "alone")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id int, text string, extra int")
    left = near.drop_near(docs)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text or "") for r in left.collect()), key=str)
    assert [(d, t.strip()) for d, t in got] == sorted([(3, rows[2][1]), (3, b), (8, "One two"), (None, ""), (None, "alone")], key=str)
    assert near.drop_near(docs.limit(0)).count() == 0


def test_stage_of_the_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, _ = brute_kept(rows)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()) == sorted(rows[i][0] for i in want)


def test_long_lists_are_divided(spark, monkeypatch):
    """Near copies of one text, and texts that share a passage, in lists longer than SMALL: all links of brute force, with lists divided by differences."""
    monkeypatch.setattr(near, "SMALL", 4)
    monkeypatch.setattr(near, "SAMPLE", 1)
    rng = random.Random(5)
    base, texts = [f"b{i}" for i in range(150)], []
    for _ in range(150):
        w = list(base)
        for _ in range(rng.choice([1, 2, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [" ".join([f"p{rng.randrange(10**6)}" for _ in range(25)] + base[:60] + ["q"] * 20) for _ in range(40)]
    asked = []
    divided = near.divided
    monkeypatch.setattr(near, "divided", lambda pairs, *more: asked.append(1) or divided(pairs, *more))
    rows = list(enumerate(texts))
    want, pairs = brute_kept(rows)
    got = sorted(r.doc_id for r in near.drop_near(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == want and pairs > 50 and asked
