"""Quality classifier: averaged subword embeddings with a softmax, trained by numpy gradient descent.

A document is the mean of learned vectors of its hashed word, word-pair and character n-grams; two output vectors and a
softmax turn the mean into the probability of label 1. Because mean and output are linear, the vectors are folded
into one logit per bucket after training, and scoring a whole text is a sum of table look-ups over its bytes.

Training uses at most SAMPLE labelled rows (those of the smallest hash of doc_id), whole texts, only rows whose
crc32(doc_id as text) mod 4 is not 2, and of them as many, in that order, as come to GRAMS counts. It runs once, in one task over their
n-gram counts that all executors make; only the model comes to the driver. Of documents that repeat a doc_id the text of the smallest hash is taken.
Labels, lang, source and doc_id are no inputs of a score.

Rows: null and empty texts score by the bias alone. Labels without doc_id or quality are left out; documents labelled
twice count twice. Where nothing is labelled all scores are 0.5, where one class is missing they tend to the other.
Every row of the input gives one row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm import common, ngrams

#: Labelled rows that are fitted, and hash bits of the buckets of each kind of n-gram.
SAMPLE, BITS = 4000, 16
#: n-gram counts that are fitted, which bounds what the task of the descent holds (four bytes each, as a rule).
GRAMS = 24_000_000
#: Size of the vectors, passes over the sample, first step of the descent.
DIM, EPOCHS, RATE = 12, 12, 2.0
CHARS = (3, 4)
KEEP = 0.7
#: Bytes of text handled at once.
PIECE = 1 << 19
KINDS = len(CHARS) + 2


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def gram_groups(raw: np.ndarray, offsets: np.ndarray):
    """For each kind of n-gram: buckets (kinds do not share any), and the n + 1 places where the rows' grams begin.

    Grams that cross the border of two rows are left out.
    """
    raw = ngrams.fold(raw)
    for kind, width in enumerate(CHARS):
        b = ngrams.char_grams(raw, width, BITS)
        stops = np.maximum(offsets[1:] - (width - 1), offsets[:-1])
        yield b + (kind << BITS), np.minimum(offsets[:-1], len(b)), np.minimum(stops, len(b))
    hashes, starts = ngrams.words(raw, offsets)
    first = np.searchsorted(starts, offsets)
    one, two = ngrams.word_grams(hashes, BITS)
    yield one + (len(CHARS) << BITS), first[:-1], first[1:]
    yield two + (len(CHARS) + 1 << BITS), np.minimum(first[:-1], len(two)), np.minimum(np.maximum(first[1:] - 1, first[:-1]), len(two))


def counts_of(text: str) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each kind of n-gram, the buckets of a text and how often they occur."""
    raw = np.frombuffer(text.encode(), np.uint8)
    ids, counts = [], []
    for kind, (b, a, z) in enumerate(gram_groups(raw, np.array([0, len(raw)], np.int64))):
        u, c = np.unique(b[a[0] : z[0]] - (kind << BITS), return_counts=True)
        ids.append(u)
        counts.append(c)
    return ids, counts


def packed(ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[bytes, bytes, int]:
    """The number of buckets of each kind, then the buckets, two bytes each; the counts in two bytes each or, where one is larger, four."""
    every = np.concatenate(counts)
    head = np.array([len(x) for x in ids], np.uint32).tobytes()
    return head + np.concatenate(ids).astype(np.uint16).tobytes(), every.astype(np.uint16 if every.max(initial=0) < 1 << 16 else np.uint32).tobytes(), len(every)


class Packed(Sequence):
    """(buckets, weights, label) of training rows, unpacked when they are asked for: four bytes a bucket are held instead of twelve."""

    def __init__(self, rows: list[tuple[int, int, bytes, bytes]]):
        self.rows = [(y, ids, counts) for _, y, ids, counts in rows]

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, k):
        y, ids, counts = self.rows[k]
        sizes = np.frombuffer(ids, np.uint32, KINDS)
        own = np.frombuffer(ids, np.uint16, offset=4 * KINDS)
        n = np.frombuffer(counts, np.uint16 if len(counts) == 2 * len(own) else np.uint32).astype(np.float64)
        kind = np.repeat(np.arange(KINDS), sizes)
        return own + (kind << BITS), n / (KINDS * np.bincount(kind, n, KINDS))[kind], y


class Held:
    """Packed training rows (_id, _y, ids, counts) that stay with the executors: how many, and the model that one task makes of them.

    The driver holds neither the counts nor the arrays of the descent."""

    def __init__(self, rows: DataFrame, n: int):
        self.rows, self.n = rows, n

    def __len__(self) -> int:
        return self.n

    def trained(self, seed: int) -> tuple[np.ndarray, float]:
        def run(batches):
            rows = []
            for b in batches:
                rows += zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)
            logit, bias = train(Packed(sorted(rows)), seed)
            yield pa.RecordBatch.from_arrays([pa.array([logit.tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["logit", "bias"])

        if not self.n:
            return train((), seed)
        model = self.rows.select("_id", "_y", "ids", "counts").coalesce(1).mapInArrow(run, "logit binary, bias double").first()
        return np.frombuffer(model["logit"], np.float32), model["bias"]


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of a text and their weights; the weights of each kind of n-gram sum to one part of KINDS."""
    ids, counts, _ = packed(*counts_of(text))
    return Packed([(0, 0, ids, counts)])[0][:2]


def train(rows: Sequence[tuple[np.ndarray, np.ndarray, int]] | Held, seed: int = 7) -> tuple[np.ndarray, float]:
    """Logit of label 1 per bucket, and the bias, from (buckets, weights, label) rows; rows that executors hold are trained on there."""
    if isinstance(rows, Held):
        return rows.trained(seed)
    labels = np.array([y for _, _, y in rows], np.int64)
    if not len(labels):
        return np.zeros(KINDS << BITS, np.float32), 0.0
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (KINDS << BITS, DIM)).astype(np.float32)
    out = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    bias = np.log(np.array([1 - share, share], np.float32))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for i in rng.permutation(len(rows)):
            ids, weights, y = rows[i]
            w = weights.astype(np.float32)
            mean = w @ vectors[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= 0.1 * rate * np.outer(mean, p)
            bias -= 0.01 * rate * p
            # a weight is small where a text is long: scaled by the largest, so that every text moves its vectors
            vectors[ids] -= (rate * (w / max(w.max(initial=0), 1e-6)))[:, None] * back
    logit = vectors @ (out[:, 1] - out[:, 0])
    return logit.astype(np.float32), float(bias[1] - bias[0])


def scores(column: pa.Array, logit: np.ndarray, bias: float) -> np.ndarray:
    raw, offsets = ngrams.text_bytes(column)
    total = np.full(len(column), bias)
    for a, z in ngrams.pieces(offsets, PIECE):
        own = offsets[a : z + 1] - offsets[a]
        for b, start, stop in gram_groups(raw[offsets[a] : offsets[z]], own):
            if len(b):
                sums = np.concatenate(([0.0], np.cumsum(logit[b], dtype=np.float64)))
                n = np.maximum(stop - start, 1)
                total[a:z] += (sums[np.maximum(stop, start)] - sums[start]) / (n * KINDS)
    return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Train on the bounded sample of labelled rows outside the held-out quarter."""
    marked = labels.filter("doc_id is not null and quality is not null").select(F.col("doc_id").cast("long").alias("_id"), (F.col("quality") > 0).cast("int").alias("_y"))
    marked = marked.filter(~held_out(F.col("_id"))).orderBy(F.xxhash64("_id"), "_id", "_y").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    common.ship(docs.sparkSession)

    def run(batches):
        for b in batches:
            found = [packed(*counts_of(t)) for t in b.column(1).to_pylist()]
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ((), (), ()), (pa.binary(), pa.binary(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, b.column(2)], names=["_id", "ids", "counts", "n", "_y"])

    ids = marked.select("_id").distinct()
    own = texts.join(F.broadcast(ids), "_id").groupBy("_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    held = common.materialise(own.join(F.broadcast(marked), "_id").select("_id", "text", "_y").mapInArrow(run, "_id long, ids binary, counts binary, n long, _y int"), "counts")
    place = F.xxhash64("_id").alias("place")
    rows = [(r["place"], r["_id"], r["n"]) for r in held.select(place, "_id", "n").orderBy("place", "_id").limit(sample).collect()]
    total, last = 0, (0, 0)
    for k, (*at, n) in enumerate(rows):
        if (total := total + n) > GRAMS and k:
            break
        last = tuple(at)
    chosen = held.filter((place < last[0]) | ((place == last[0]) & (F.col("_id") <= last[1])))
    return train(Held(chosen, sum((p, i) <= last for p, i, _ in rows)))


def scored(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score: one row for each row of docs. The model (one megabyte) goes out as a broadcast variable."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        logit, bias = sent.value
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores(b.column(1), logit, bias), pa.float64())], names=["doc_id", "score"])

    return common.map_rows(common.texts_of(docs), ["doc_id", "text"], "doc_id long, score double", run)


def drop_rejected(docs: DataFrame, model: tuple[np.ndarray, float], keep: float = KEEP) -> DataFrame:
    """The rows of docs that score at least `keep`, with all their columns."""
    common.ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        logit, bias = sent.value
        for b in batches:
            texts = b.column(at).fill_null("")
            yield b.filter(pa.array(scores(texts, logit, bias) >= keep))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = scored(docs, fit(docs, common.table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted"))


QUERIES: dict[str, Callable] = {"op7_quality": op7_quality}
SQL: dict[str, str] = {}
