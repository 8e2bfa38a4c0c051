"""Document quality from random-indexing word vectors and a small network.

* *Random indexing.* A token has a fixed sparse index vector (a few places hold +1 or -1, by hash). Its context vector is
  the sum of the index vectors of its neighbours over the whole corpus, so one pass of additions builds all vectors.
  Tokens share ``BUCKETS`` rows by hash, which bounds the table; tasks add up their own part, parts meet by block.
* *Pooling.* A document is the mean and the spread of its tokens' vectors.
* *Network.* Two layers, trained in numpy on at most ``MAX_LABELLED`` labelled rows with crc32(doc_id) mod 5 not 0. A fifth of
  them fits the temperature that makes the outputs probabilities.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlore.llm.common import corpus_sum, mix64, table, text_groups

BUCKETS = 1 << 15
DIMENSIONS = 32
PLACES = 2
REACH = 2
MAX_LABELLED = 20_000
HIDDEN = 32
EPOCHS = 40
THRESHOLD = 0.3
#: Words, numbers and runs of other signs are tokens.
TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^\sA-Za-z0-9\x80-\xff]+")


def token_buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every token of all texts, and the number of tokens of each text."""
    lists = [TOKEN.findall(t) for t in texts]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = np.fromiter((h for x in lists for h in map(zlib.crc32, x)), np.uint32, int(sizes.sum()))
    return (flat & np.uint32(BUCKETS - 1)).astype(np.int64), sizes


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's index vector."""
    h = mix64(np.arange(BUCKETS * PLACES, dtype=np.uint64) + np.uint64(77)).reshape(BUCKETS, PLACES)
    return (h % np.uint64(DIMENSIONS)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


def add_contexts(total: np.ndarray, buckets: np.ndarray, sizes: np.ndarray, place: np.ndarray, sign: np.ndarray) -> None:
    """Adds the index vectors of all neighbours within REACH in the same text."""
    owner = np.repeat(np.arange(sizes.size), sizes)
    for gap in range(1, REACH + 1):
        same = owner[gap:] == owner[:-gap]
        a, b = buckets[:-gap][same], buckets[gap:][same]
        for x, y in ((a, b), (b, a)):
            for k in range(PLACES):
                total += np.bincount(x * DIMENSIONS + place[y, k], sign[y, k], total.size).astype(np.int64)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The unit context vector of every bucket, less the mean vector: BUCKETS x DIMENSIONS on the driver."""
    place, sign = index_vectors()
    total = corpus_sum(docs, BUCKETS * DIMENSIONS, lambda own, texts: add_contexts(own, *token_buckets(texts), place, sign))
    vectors = total.reshape(BUCKETS, DIMENSIONS).astype(np.float64)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = vectors / np.maximum(norm, 1)
    used = norm[:, 0] > 0
    return (unit - unit[used].mean(axis=0) * used[:, None] if used.any() else unit).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Mean, spread and length of the mean of each text's token vectors; zeros without tokens."""
    buckets, sizes = token_buckets(texts)
    out = np.zeros((len(texts), 2 * DIMENSIONS + 1), np.float32)
    full = np.flatnonzero(sizes)
    at = 0
    for i in full:
        own = vectors[buckets[at : at + sizes[i]]]
        at += sizes[i]
        mean = own.mean(axis=0)
        out[i, :DIMENSIONS], out[i, DIMENSIONS:-1], out[i, -1] = mean, own.std(axis=0), np.linalg.norm(mean)
    return out


class Network:
    """One hidden layer, a logistic output, and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, fit: np.ndarray, seed: int = 1):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        self.w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        self.train(((x - self.mean) / self.scale)[fit], y[fit], rng)
        rest = ~fit if (~fit).any() else fit
        self.calibrate(self.logits(x[rest]), y[rest])

    def train(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator, size: int = 256, rate: float = 3e-3, decay: float = 1e-4) -> None:
        first, second, step = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            now = rate * (1 - epoch / EPOCHS) + 1e-5
            for lo in range(0, len(x), size):
                a, t = x[order[lo : lo + size]], y[order[lo : lo + size]]
                h = np.tanh(a @ self.w[0] + self.w[1])
                g = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - t) / len(a)
                back = np.outer(g, self.w[2]) * (1 - h * h)
                grads = [a.T @ back + decay * self.w[0], back.sum(axis=0), h.T @ g + decay * self.w[2], g.sum(keepdims=True)]
                step += 1
                for w, d, m, v in zip(self.w, grads, first, second, strict=True):
                    m += 0.1 * (d - m)
                    v += 0.001 * (d * d - v)
                    w -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least log loss, by golden section on its logarithm."""

        def loss(log_t: float) -> float:
            s = z / np.exp(log_t)
            return float(np.mean(np.logaddexp(0, s) - y * s))

        lo, hi, r = -2.0, 3.0, (5**0.5 - 1) / 2
        for _ in range(60):
            a, b = hi - r * (hi - lo), lo + r * (hi - lo)
            lo, hi = (lo, b) if loss(a) < loss(b) else (a, hi)
        self.temperature = float(np.exp((lo + hi) / 2))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5; 0 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int) -> DataFrame:
    """(text, y, part) of at most ``limit`` labelled rows that aren't held out, by hash of the id."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold(F.col("doc_id")) != 0))
    one = usable.groupBy("doc_id").agg(F.min(label).cast("double").alias("y"))
    chosen = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(5))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    once = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))  # of rows that repeat an id, one
    return once.select("text", "y", part.alias("part"), "doc_id")


def fit_network(docs: DataFrame, labels: DataFrame, vectors, label: str = "quality", limit: int = MAX_LABELLED) -> Network | None:
    """A network from the labelled sample; None without labels."""

    def pool(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_groups(batches, 0):
            yield pa.RecordBatch.from_arrays(
                [part.column(1), part.column(2), part.column(3), pa.array([r.tobytes() for r in pooled(texts, vectors.value)], pa.binary())],
                names=["y", "part", "doc_id", "x"],
            )

    rows = labelled_sample(docs, labels, label, limit).mapInArrow(pool, "y double, part long, doc_id long, x binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.doc_id, r.x))
    x = np.frombuffer(b"".join(bytes(r.x) for r in rows), np.float32).reshape(len(rows), -1).astype(np.float64)
    part = np.array([r.part for r in rows])
    return Network(x, np.array([r.y for r in rows]), part != 0 if (part != 0).any() else part == 0)


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs`` (doc_id, text).

    The score sees the text alone. Null and empty texts have zero features and get the network's answer to them. Of
    labels that disagree on a doc_id the smaller counts; null labels and ids don't. Without usable labels all
    scores are 0.5. Repeated rows each get a row; a null doc_id is not held out; other columns are not read.
    """
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs))
    network = fit_network(docs, labels, vectors, label, limit)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_groups(batches, 2):
            p = network.score(pooled(texts, vectors.value)) if network else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(p, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
