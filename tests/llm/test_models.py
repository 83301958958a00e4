import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quadrille.llm import language, ngrams, quality


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_batches_score_like_single_texts():
    rng = random.Random(3)
    texts = ["", " ", "ab", "abc", "Word", "two words", "two  words two two", "é ñ 漢字", *("".join(rng.choice("abcd éñ\n.") for _ in range(rng.randrange(400))) for _ in range(60))]
    logit = np.random.default_rng(0).normal(size=quality.KINDS << quality.BITS).astype(np.float32)
    want = []
    for t in texts:
        ids, w = quality.counted(t)
        want.append(1 / (1 + np.exp(-(0.3 + float(w @ logit[ids])))))
    whole = quality.scores(pa.array(texts), logit, 0.3)
    assert np.allclose(whole, want, atol=1e-5)
    assert np.allclose(quality.scores(pa.array(["x", *texts, "y"])[1:-1], logit, 0.3), whole)


def test_pieces_cover_all_rows(monkeypatch):
    texts = ["a" * n for n in (0, 5, 100, 3, 0, 7)]
    _, offsets = ngrams.text_bytes(pa.array(texts))
    assert [i for a, z in ngrams.pieces(offsets, 8) for i in range(a, z)] == list(range(6))


def test_word_hashes_depend_on_words_only():
    h1, _ = ngrams.words(ngrams.fold(np.frombuffer(b" one  two one", np.uint8)))
    h2, _ = ngrams.words(ngrams.fold(np.frombuffer(b"ONE two", np.uint8)))
    assert h1[0] == h1[2] == h2[0] and h1[1] == h2[1] and len(set(h1)) == 2


def auc(scores, labels):
    rank = np.argsort(np.argsort(scores))
    pos = labels == 1
    return (rank[pos].mean() - (pos.sum() - 1) / 2) / (~pos).sum()


def test_quality_query_on_held_out_rows(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    rows = {r.doc_id: r for r in quality.op7_quality(spark, big).collect()}
    assert len(rows) == spark.read.parquet(f"{big}/documents.parquet").count()
    assert all(r.held_out == held(i) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for i, r in rows.items())
    marked = [(rows[r.doc_id].score, r.quality) for r in spark.read.parquet(f"{big}/labels.parquet").collect() if r.doc_id in rows and held(r.doc_id)]
    s, y = np.array([m[0] for m in marked]), np.array([m[1] for m in marked])
    assert auc(s, y) > 0.95 and ((s >= 0.7) == y).mean() > 0.9


def test_language_query_on_held_out_rows(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{big}/documents.parquet").collect()}
    rows = language.op8_language(spark, big).collect()
    assert len(rows) == len(truth) and all(r.held_out == held(r.doc_id) for r in rows)
    own = [r for r in rows if r.held_out and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in own]) > 0.95


MASK = (1 << 64) - 1


def brute_quality(text, logit, bias):
    """The mean logit of each kind of n-gram, counted one by one with Python's integers."""
    folded = [32 if b < 33 else b + 32 if 65 <= b <= 90 else b for b in text.encode()]
    mix, step, top = 0x9E3779B97F4A7C15, 0x100000001B3, 64 - quality.BITS
    kinds = []
    for width in quality.CHARS:
        own = []
        for i in range(len(folded) - width + 1):
            h = width
            for b in folded[i : i + width]:
                h = (h * step + b) & MASK
            own.append((h * mix & MASK) >> top)
        kinds.append(own)
    words = []
    for w in bytes(folded).split(b" "):
        if w:
            h = sum((b + 1) * pow(step, k, 1 << 64) for k, b in enumerate(w)) & MASK
            words.append((h ^ h >> 29) * mix & MASK)
    kinds.append([w >> top for w in words])
    kinds.append([0 if a == b else (((a * step + b) & MASK) * mix & MASK) >> top for a, b in zip(words, words[1:], strict=False)])
    z = bias
    for k, own in enumerate(kinds):
        if own:
            z += sum(float(logit[(k << quality.BITS) + g]) for g in own) / len(own) / quality.KINDS
    return 1 / (1 + np.exp(-z))


def test_quality_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    logit, bias = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert np.abs(logit).max() > 0
    got = {r.doc_id: r for r in quality.op7_quality(spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for d in rows:
        want = brute_quality(d.text or "", logit, bias)
        assert abs(got[d.doc_id].score - want) < 1e-6 and got[d.doc_id].predicted == (got[d.doc_id].score >= 0.7)


def brute_language(text, net):
    """Every window by its own convolution with the fitted kernels, weighted by the bytes it holds."""
    codes = [int(language.CLASS[b]) for b in text.encode()]
    *kernels, offset, dense, bias = net.params
    total = np.zeros(len(bias))
    for at in range(0, max(1, len(codes)), language.LENGTH):
        own = codes[at : at + language.LENGTH]
        window = np.array(own + [0] * (language.LENGTH - len(own)))
        tops = []
        for w, kernel in zip(language.WIDTHS, kernels, strict=True):
            best = np.full(language.FILTERS, -np.inf)
            for i in range(language.LENGTH - w + 1):
                best = np.maximum(best, sum(kernel[j, window[i + j]] for j in range(w)))
            tops.append(best)
        z = np.maximum(np.concatenate(tops) + offset, 0) @ dense + bias
        p = np.exp(z - z.max())
        total += p / p.sum() * max(len(own), 1)
    total /= total.sum()
    return net.languages[int(total.argmax())], float(total.max())


def test_language_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    net = language.fit(docs)
    got = {r.doc_id: r for r in language.op8_language(spark, sf_dir).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    short = sorted(rows, key=lambda d: len(d.text or ""))
    for d in short:
        if not any(map(str.isalpha, d.text or "")):
            assert (got[d.doc_id].lang_pred, got[d.doc_id].score) == ("und", 0.0)
        else:
            name, score = brute_language(d.text, net)
            assert got[d.doc_id].lang_pred == name and abs(got[d.doc_id].score - score) < 1e-4


def test_training_rows_are_bounded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"good text number {i}") for i in range(50)] + [(i, "bad words only") for i in range(2, 40)], "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = spark.createDataFrame([(i, int(i == 1)) for i in range(1, 40)], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda rows: seen.append(rows) or (np.zeros(quality.KINDS << quality.BITS, np.float32), 0.0))
    quality.fit(docs, labels)
    quality.fit(docs, labels, sample=5)
    monkeypatch.setattr(quality, "GRAMS", 100)
    quality.fit(docs, labels)
    known = sum(not held(i) for i in range(1, 40))
    assert [len(seen[0]), len(seen[1])] == [known, 5] and 0 < len(seen[2]) < 5


def test_tables_give_the_sums_of_the_filters():
    net = language.Network(["a", "b"])
    net.tables()
    codes = np.random.default_rng(1).integers(0, language.CLASSES, (3, language.LENGTH))
    want = []
    for w, kernel in zip(language.WIDTHS, net.params, strict=False):
        span = language.LENGTH - w + 1
        want.append(sum(kernel[j][codes[:, j : j + span]] for j in range(w)).max(axis=1))
    assert np.allclose(net.pooled(codes), np.concatenate(want, axis=1), atol=1e-5)


def test_windows_hold_every_byte():
    texts = ["", "a" * 255, "b" * 256, "c" * 257, "d" * 600]
    raw, offsets = ngrams.text_bytes(pa.array(texts))
    codes, rows, size = language.windows(raw, offsets)
    assert rows.tolist() == [0, 1, 2, 3, 3, 4, 4, 4] and size.tolist() == [0, 255, 256, 256, 1, 256, 256, 88]
    assert (codes != 0).sum() == len(raw)


def test_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", 0.5), (2, "", "en", 0.5), (2, "", "en", 0.5), (None, "some text", None, 0.5), (5, "12 34!", "de", 0.5), (6, "wort " * 50_000, "de", 0.5)], "doc_id long, text string, lang string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, none)
    got = quality.scored(docs, model).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5}
    assert quality.drop_rejected(docs, model).count() == 0 and quality.drop_rejected(docs, model, 0.5).columns == docs.columns
    assert quality.drop_rejected(docs, model, 0.5).count() == 6
    labels = spark.createDataFrame([(1, 1), (5, 0), (6, 1), (6, 1), (None, 1), (2, None), (99, 1)], "doc_id long, quality int")
    assert quality.scored(docs, quality.fit(docs, labels)).count() == 6
    net = language.fit(docs)
    got = language.predicted(docs, net).collect()
    assert len(got) == 6 and [r.lang_pred for r in got if r.doc_id in (1, 2, 5)] == ["und"] * 4
    blank = language.fit(docs.drop("lang").selectExpr("*", "cast(null as string) lang"))
    assert {(r.lang_pred, r.score) for r in language.predicted(docs, blank).collect()} == {("und", 0.0)}
    assert quality.scored(docs.limit(0), model).count() == 0 == language.predicted(docs.limit(0), net).count()
