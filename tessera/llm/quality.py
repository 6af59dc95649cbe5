"""Operator 5: quality scores from random-indexing word vectors and a two-layer network.

Each word and each word shape (runs of letter case, digits and marks) has a row in tables of fixed
size and a sparse random index vector that follows from its hash. A row's context vector sums the index
vectors of its neighbours over the training texts. A document pools the vectors of its words: mean,
deviation, the share of words that repeat their neighbour, length. A two-layer network in numpy turns
that into a logit; one temperature, fitted on rows that the network was not trained on,
calibrates it.

The model is fitted on at most ``sample`` labelled rows, those with the smallest hash of doc_id;
the bound is a parameter. Scores are computed for all documents, whole texts.

Defined cases: null and empty texts pool to zeros and get the score of that; labels that contradict each
other or are null are left out; without labels of both kinds the score is the share of label 1 (0.5
without any); rows may repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.base import column_bytes, mapped, per_batch, table

SAMPLE = 6000
WORDS, SHAPES, DIM, NONZERO = 1 << 14, 1 << 10, 64, 4
HIDDEN = 32
THRESHOLD = 0.7
#: Byte classes of a shape: upper U, lower (and beyond ASCII) l, digit 0, any other mark itself.
CLASS = bytes(85 if 65 <= b <= 90 else 108 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
MARKS = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))


def index_vectors() -> np.ndarray:
    rng = np.random.default_rng(5)
    out = np.zeros((WORDS + SHAPES, DIM), np.float32)
    for k in range(NONZERO):
        np.add.at(out, (np.arange(len(out)), rng.integers(0, DIM, len(out))), np.where(k % 2, 1, -1))
    return out


class Rows:
    """The rows of words and shapes; what was met is kept up to a bound."""

    def __init__(self, most: int = 300_000):
        self.seen: dict[bytes, tuple[int, int]] = {}
        self.most = most

    def __call__(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.split() if text else []
        if len(self.seen) > self.most:
            self.seen.clear()
        seen = self.seen
        for w in set(words):
            if w not in seen:
                seen[w] = self._row(w)
        both = np.array([seen[w] for w in words], np.int32).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    @staticmethod
    def _row(word: bytes) -> tuple[int, int]:
        shape = bytearray()
        for c in word.translate(CLASS)[:64]:
            if not shape or c != shape[-1]:
                shape.append(c)
        own = word.translate(LOWER, MARKS)
        return zlib.crc32(own) % WORDS, WORDS + zlib.crc32(bytes(shape[:12])) % SHAPES


def context_sums(texts: list[bytes | None], index: np.ndarray, reach: int = 2) -> np.ndarray:
    rows, sums = Rows(), np.zeros_like(index)
    for text in texts:
        w, s = rows(text)
        if len(w) < 2:
            continue
        own = index[w] + index[s]
        around = index[s].copy()
        for d in range(1, reach + 1):
            around[d:] += own[:-d]
            around[:-d] += own[d:]
        np.add.at(sums, w, around)
        np.add.at(sums, s, around)
    return sums


def vectors(sums: np.ndarray, index: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(sums, axis=1, keepdims=True)
    return np.where(norm > 0, sums / np.maximum(norm, 1e-9), index / np.sqrt(NONZERO)).astype(np.float32)


def pooled(text: bytes | None, rows: Rows, table_: np.ndarray) -> np.ndarray:
    out = np.zeros(3 * DIM + 5, np.float32)
    w, s = rows(text)
    if not len(w):
        return out
    a, b = table_[w], table_[s]
    mean, shape = a.mean(axis=0), b.mean(axis=0)
    out[:DIM], out[DIM : 2 * DIM], out[2 * DIM : 3 * DIM] = mean, shape, np.abs(a - mean).mean(axis=0)
    out[3 * DIM :] = np.linalg.norm(mean), np.linalg.norm(shape), np.mean(w[1:] == w[:-1]) if len(w) > 1 else 0, len(np.unique(w)) / len(w), np.log1p(len(w))
    return out


class Network:
    """Standardised inputs, one hidden layer, one logit divided by a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, epochs: int = 60, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.base = float(y.mean()) if len(y) else 0.5
        self.weights: list[np.ndarray] | None = None
        fit = ~held
        if len(np.unique(y[fit])) < 2:
            return
        self.centre, self.scale = x[fit].mean(axis=0), x[fit].std(axis=0) + 1e-3
        z = (x - self.centre) / self.scale
        n, d = int(fit.sum()), x.shape[1]
        p = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
        zf, yf, step = z[fit], y[fit], 0
        for _ in range(epochs):
            order = rng.permutation(n)
            for at in range(0, n, 128):
                i = order[at : at + 128]
                h = np.tanh(zf[i] @ p[0] + p[1])
                g = (sigmoid(h @ p[2] + p[3]) - yf[i]) / len(i)
                gh = np.outer(g, p[2]) * (1 - h * h)
                grads = [zf[i].T @ gh + 1e-3 * p[0], gh.sum(axis=0), h.T @ g + 1e-3 * p[2], np.array([g.sum()])]
                step += 1
                for q, gq, mq, vq in zip(p, grads, m, v, strict=True):
                    mq += 0.1 * (gq - mq)
                    vq += 0.001 * (gq * gq - vq)
                    q -= 3e-3 * (mq / (1 - 0.9**step)) / (np.sqrt(vq / (1 - 0.999**step)) + 1e-8)
        self.weights = p
        self.temperature = 1.0
        if held.any():
            logit = self.logits(x[held])
            loss = lambda t: np.logaddexp(0, np.where(y[held] > 0, -1, 1) * logit / t).mean()
            self.temperature = min(np.geomspace(0.25, 8, 101), key=loss)

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.weights
        return np.tanh((x - self.centre) / self.scale @ p[0] + p[1]) @ p[2] + p[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(x) / self.temperature) if self.weights is not None else np.full(len(x), self.base)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> tuple[np.ndarray, Network]:
    """The word vectors and the network, from at most ``sample`` labelled rows that are not held out."""
    spark = docs.sparkSession
    index = index_vectors()
    known = labels.where(F.col("doc_id").isNotNull() & ~held_out() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).alias("y"), F.max(label).alias("other"))
    chosen = known.where("y = other").select("doc_id", "y").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # an id with several rows counts by its least text, so that the bound is one of rows
    one = F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least")
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(one).select("doc_id", "least.text", "y")

    def contexts(batches):
        own = index_vectors()
        total = np.zeros_like(own)
        for batch in batches:
            total += context_sums(column_bytes(batch, "text"), own)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    def added(batches):
        total = np.zeros_like(index)
        for batch in batches:
            for sums in batch.column(0).to_pylist():
                total += np.frombuffer(sums, np.float32).reshape(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    # tables of a fixed size: added up by twos and threes, so that the driver gets one
    parts = texts.repartition(8, "doc_id").mapInArrow(contexts, "sums binary").repartition(1).mapInArrow(added, "sums binary").collect()
    table_ = vectors(np.frombuffer(parts[0].sums, np.float32).reshape(index.shape) if parts else np.zeros_like(index), index)
    held = spark.sparkContext.broadcast(table_)

    def features():
        rows = Rows()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [pooled(t, rows, held.value).tobytes() for t in column_bytes(batch, "text")]
            return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), batch.column(2).cast(pa.int32()), pa.array(got, pa.binary())], ["doc_id", "y", "x"])

        return one

    got = sorted((zlib.crc32(r.doc_id.encode()), r.doc_id, r.y, bytes(r.x)) for r in texts.select("doc_id", "text", "y").mapInArrow(per_batch(features), "doc_id string, y int, x binary").collect())
    x = np.frombuffer(b"".join(r[3] for r in got), np.float32).reshape(-1, 3 * DIM + 5).astype(np.float64)
    y = np.array([r[2] for r in got], np.float64)
    return table_, Network(x, y, np.array([zlib.crc32(b"calibrate" + r[1].encode()) % 5 == 0 for r in got], bool))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, label: str = "quality") -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, sample, label))
    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def make():
        rows = Rows()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            table_, net = model.value
            x = np.stack([pooled(t, rows, table_) for t in column_bytes(batch, "text")]).astype(np.float64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.scores(x))], ["doc_id", "score"])

        return one

    scored = source.mapInArrow(per_batch(make), f"doc_id {dict(source.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def saved(model: tuple[np.ndarray, Network]) -> bytes:
    """The model as an .npz file."""
    out = io.BytesIO()
    table_, net = model
    np.savez_compressed(out, table=table_, centre=net.centre, scale=net.scale, temperature=net.temperature, **{f"p{k}": p for k, p in enumerate(net.weights)})
    return out.getvalue()


def op5_random_indexing(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text is not rejected, with docs' own columns."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels))
    names = docs.columns
    at = names.index("text")

    def make():
        rows = Rows()

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            table_, net = model.value
            texts = batch.column(at).cast(pa.binary()).to_pylist()
            x = np.stack([pooled(t, rows, table_) for t in texts]).astype(np.float64)
            return batch.filter(pa.array(net.scores(x) >= THRESHOLD))

        return one

    return mapped(docs, make)
