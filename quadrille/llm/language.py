"""Language identification by a byte convolutional network, trained in numpy.

Bytes are folded into 64 classes (letters, digits, lead and continuation bytes of UTF-8). Filters of several widths run
over windows of fixed length, their maxima over a window feed a softmax, and the probabilities of all windows of a text,
weighted by the bytes they hold, are averaged. Every byte of a text lies in one window; the last one is padded.
For speed a filter is applied as table look-ups over pairs of classes, which gives the same sums.

Training takes at most SAMPLE documents with a lang (those of the smallest hash of doc_id), only those whose crc32(doc_id as
text) mod 4 is not 2, and WINDOWS windows of each; of those that repeat a doc_id and lang, the text of the smallest hash. It runs once on the driver. lang, source and doc_id are no inputs
of a prediction.

Rows: null texts and texts without a letter give `und` with score 0; so does every text where no row has a lang. Each
row of the input gives one row.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import common, ngrams
from quadrille.llm.quality import held_out

SAMPLE, WINDOWS = 2000, 4
LENGTH, FILTERS, WIDTHS = 256, 16, (2, 3, 4)
EPOCHS, BATCH, RATE = 6, 64, 0.01
CLASSES = 64
#: Windows that are convolved at once.
STRIPE = 128


def _classes() -> np.ndarray:
    """Class of each byte: 0 other, 1-26 letters, 27 digits, 28 punctuation, 29 and 30 lead bytes, 31 and up continuation bytes with the bit of case dropped."""
    table = np.zeros(256, np.int64)
    for b in range(33, 128):
        table[b] = 28
    table[ord("0") : ord("9") + 1] = 27
    for k in range(26):
        table[ord("a") + k] = table[ord("A") + k] = 1 + k
    table[0xC0:] = 30
    table[0xC3] = 29
    for b in range(0x80, 0xC0):
        table[b] = 31 + (b & 31)
    return table


CLASS = _classes()


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class codes of all windows (n, LENGTH), the row of each and the bytes it holds; empty rows have one empty window."""
    sizes = np.diff(offsets)
    counts = np.maximum(1, -(-sizes // LENGTH))
    first = np.concatenate(([0], np.cumsum(counts)))
    out = np.zeros(int(first[-1]) * LENGTH, np.int64)
    out[np.arange(len(raw)) + np.repeat(first[:-1] * LENGTH - offsets[:-1], sizes)] = CLASS[raw]
    rows = np.repeat(np.arange(len(sizes)), counts)
    held = np.minimum(LENGTH, sizes[rows] - (np.arange(len(rows)) - first[rows]) * LENGTH)
    return out.reshape(-1, LENGTH), rows, np.maximum(held, 0)


class Network:
    """kernels[w]: (w, CLASSES, FILTERS); dense: (filters of all widths, languages)."""

    def __init__(self, languages: list[str], seed: int = 5):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.params = [rng.normal(0, 0.3, (w, CLASSES, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.params += [np.zeros(FILTERS * len(WIDTHS), np.float32)]
        self.params += [rng.normal(0, 0.1, (FILTERS * len(WIDTHS), max(1, len(languages)))).astype(np.float32), np.zeros(max(1, len(languages)), np.float32)]

    def _train_step(self, codes: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        n = len(codes)
        *kernels, offset, dense, bias = self.params
        tops, places = [], []
        for w, kernel in zip(WIDTHS, kernels, strict=True):
            span = LENGTH - w + 1
            conv = sum(kernel[j][codes[:, j : j + span]] for j in range(w))
            place = conv.argmax(axis=1)
            places.append(place)
            tops.append(np.take_along_axis(conv, place[:, None, :], axis=1)[:, 0])
        pooled = np.concatenate(tops, axis=1) + offset
        hidden = np.maximum(pooled, 0)
        z = hidden @ dense + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), labels] -= 1
        p /= n
        back = (p @ dense.T) * (pooled > 0)
        grads = []
        for k, (w, kernel) in enumerate(zip(WIDTHS, kernels, strict=True)):
            g = np.zeros_like(kernel)
            own = back[:, k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                at = np.take_along_axis(codes, places[k] + j, axis=1)
                np.add.at(g[j], (at, np.arange(FILTERS)[None, :]), own)
            grads.append(g)
        return [*grads, back.sum(axis=0), hidden.T @ p, p.sum(axis=0)]

    def train(self, codes: np.ndarray, labels: np.ndarray, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(p) for p in self.params]
        second = [np.zeros_like(p) for p in self.params]
        step = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(codes))
            for at in range(0, len(order), BATCH):
                own = order[at : at + BATCH]
                step += 1
                for p, g, m, v in zip(self.params, self._train_step(codes[own], labels[own]), first, second, strict=True):
                    m *= 0.9
                    m += 0.1 * g
                    v *= 0.999
                    v += 0.001 * g * g
                    p -= RATE * (1 - epoch / EPOCHS) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def tables(self) -> None:
        """Sums of a filter's first and last two columns for every pair of classes."""
        pair = lambda a, b: (a[:, None, :] + b[None, :, :]).reshape(-1, FILTERS)
        two, three, four = self.params[:3]
        self.two, self.three, self.last = pair(two[0], two[1]), pair(three[0], three[1]), three[2]
        self.four, self.end = pair(four[0], four[1]), pair(four[2], four[3])

    def pooled(self, codes: np.ndarray) -> np.ndarray:
        pairs = codes[:, :-1] * CLASSES + codes[:, 1:]
        two = self.two[pairs].max(axis=1)
        three = self.three[pairs[:, :-1]]
        three += self.last[codes[:, 2:]]
        four = self.four[pairs[:, :-2]]
        four += self.end[pairs[:, 2:]]
        return np.concatenate((two, three.max(axis=1), four.max(axis=1)), axis=1)

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        offset, dense, bias = self.params[3:]
        out = np.empty((len(codes), len(bias)))
        for at in range(0, len(codes), STRIPE):
            z = np.maximum(self.pooled(codes[at : at + STRIPE]) + offset, 0) @ dense + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + STRIPE] = p / p.sum(axis=1, keepdims=True)
        return out

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; texts must not be null."""
        raw, offsets = ngrams.text_bytes(column)
        names: list[str] = []
        scores = np.zeros(len(column))
        for a, z in ngrams.pieces(offsets, 1 << 20):
            codes, rows, held = windows(raw[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
            p = self.probabilities(codes) * np.maximum(held, 1)[:, None]
            total = np.add.reduceat(p, np.searchsorted(rows, np.arange(z - a)), axis=0)
            total /= total.sum(axis=1, keepdims=True)
            best = total.argmax(axis=1)
            scores[a:z] = total[np.arange(z - a), best]
            names += [self.languages[k] for k in best] if self.languages else ["und"] * (z - a)
        for k, text in enumerate(column.to_pylist()):
            if not self.languages or not any(map(str.isalpha, text)):
                names[k], scores[k] = "und", 0.0
        return names, np.minimum(scores, 1.0)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Network:
    """Train on windows of the bounded sample of documents with a lang outside the held-out quarter."""
    known = docs.filter("doc_id is not null and lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("_id"), F.col("lang").cast("string").alias("_lang"), F.col("text").cast("string").alias("text"))
    # ids first, texts then: only the sample's texts are sorted or sent
    ids = known.filter(~held_out(F.col("_id"))).select("_id", "_lang").orderBy(F.xxhash64("_id"), "_id", "_lang").limit(sample).distinct()
    common.ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            raw, offsets = ngrams.text_bytes(b.column(2))
            keep_id, keep_lang, found = [], [], []
            for k, (i, lang) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                own = raw[offsets[k] : offsets[k + 1]]
                codes = windows(own, np.array([0, len(own)], np.int64))[0].astype(np.uint8)
                for w in np.unique(np.linspace(0, len(codes) - 1, WINDOWS).round().astype(int)):
                    keep_id.append(i)
                    keep_lang.append(lang)
                    found.append(codes[w].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keep_id, pa.int64()), pa.array(keep_lang, pa.string()), pa.array(found, pa.binary())], names=["_id", "_lang", "codes"])

    own = known.join(F.broadcast(ids), ["_id", "_lang"]).groupBy("_id", "_lang").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    rows = own.select("_id", "_lang", "text").mapInArrow(run, "_id long, _lang string, codes binary").toArrow().to_pylist()
    rows.sort(key=lambda r: (r["_id"], r["_lang"], r["codes"]))
    net = Network(sorted({r["_lang"] for r in rows}))
    if rows:
        codes = np.stack([np.frombuffer(r["codes"], np.uint8) for r in rows]).astype(np.int64)
        net.train(codes, np.array([net.languages.index(r["_lang"]) for r in rows]))
    net.tables()
    return net


def predicted(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, lang_pred, score: one row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        for b in batches:
            names, scores = sent.value.predict(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return common.map_rows(common.texts_of(docs), ["doc_id", "text"], "doc_id long, lang_pred string, score double", run)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return predicted(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable] = {"op8_language": op8_language}
SQL: dict[str, str] = {}
