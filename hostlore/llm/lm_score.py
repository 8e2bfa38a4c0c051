"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from the two tokens before and the two after it, as if it were masked; the sum of the logarithms of
these conditional probabilities scores the document.

1. *Vocabulary.* An exact count of all words of the corpus. The ``OWN`` most frequent have classes of their own; every
   other word is in one of ``ENDINGS`` classes by its last two bytes, and has within it the probability that a spelling
   model (byte trigrams, counted over all such words of the corpus) gives it.
2. *Network.* The classes around a place are embedded by place, summed and squashed; from there a softmax over
   ``CLUSTERS`` clusters and one within the cluster give the class. It is trained in numpy on every document, at
   all of its places: a task runs over its own texts from common beginnings, tasks are averaged by their numbers
   of windows, and all of it happens ``ROUNDS`` times. The counts of words and the networks of tasks grow with the corpus.
3. *Scores.* Another pass predicts every token and sums each document's conditional log-probabilities.

The driver holds one network (1 MB), the spelling counts and the ``OWN`` words, whatever the corpus.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlore.llm.common import block_sums, corpus_sum, release, table, text_groups, to_blocks, written

#: Places of a window, in words from the one to predict.
AROUND = (-2, -1, 1, 2)
CLUSTERS = 48
CLASSES = CLUSTERS * CLUSTERS
ENDINGS = 255
#: Class 0 stands outside the text; then come the words with classes of their own, then endings.
OWN = CLASSES - ENDINGS - 1
#: Longer words are in no class of their own.
LONGEST = 64
HIDDEN = 16
ROUNDS = 1
BATCH = 1 << 14
RATE = 0.1
#: Classes and spellings of rare words that a process keeps.
CACHE_WORDS = 200_000
#: Columns of scores that are exponentiated at once.
COLUMNS = 1 << 13
#: Scores up to this size have exponentials, and sums of them, that 32-bit numbers hold.
SAFE = 80
#: Fractions of the networks when they are added up as whole numbers, so that their order doesn't matter.
UNIT = 1 << 20


class Classes(dict):
    """Word to class; words without a class of their own get that of their ending, and some are remembered."""

    def __missing__(self, word: bytes) -> int:
        found = 1 + OWN + zlib.crc32(word[-2:]) % ENDINGS
        if len(self) < OWN + CACHE_WORDS and len(word) <= LONGEST:
            self[word] = found
        return found


def split_words(text: bytes) -> list[bytes]:
    return text.lower().split()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): every word of the corpus and how often it occurs. A written table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in text_groups(batches, 0, 4 << 20):
            own = Counter(w for t in texts for w in split_words(t))
            yield pa.RecordBatch.from_arrays([pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], names=["word", "n"])
        release()

    return written(docs.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")), "vocabulary")


# the spelling model: bytes in kinds, a kind's bytes alike
COMMON = b"abcdefghijklmnopqrstuvwxyz0123456789.,'-\"():;!?/"
KIND = np.array([1 + COMMON.index(b) if b in COMMON else 1 + len(COMMON) + b % 15 for b in range(256)], np.int64)
END = 1 + len(COMMON) + 15
KINDS = END + 1
WITHIN = np.log(np.maximum(1, np.bincount(KIND, minlength=KINDS))).astype(np.float64)


def trigrams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(kind before the last, last kind, kind) of every byte and of each word's end as one number; and the word it is of."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    kind = KIND[np.frombuffer(b" ".join([*words, b""]), np.uint8)]
    ends = np.cumsum(sizes) - 1
    kind[ends] = END
    owner = np.repeat(np.arange(sizes.size), sizes)
    one, two = np.zeros_like(kind), np.zeros_like(kind)
    one[1:], two[2:] = kind[:-1], kind[:-2]
    first = ends - sizes + 1
    one[first] = two[first] = 0
    second = first[sizes > 1] + 1
    two[second] = 0
    return (two * KINDS + one) * KINDS + kind, owner


class Spelling:
    """Probabilities of words from weighted counts of kinds, smoothed by shorter contexts."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(KINDS, KINDS, KINDS).astype(np.float64)
        c2 = c3.sum(axis=0)
        p1 = (c2.sum(axis=0) + 1) / (c2.sum() + KINDS)
        p2 = (c2 + 20 * p1) / (c2.sum(axis=1, keepdims=True) + 20)
        self.log_p = np.log((c3 + 20 * p2) / (c3.sum(axis=2, keepdims=True) + 20)).ravel()
        self.known: dict[bytes, float] = {}

    def log_probability(self, words: list[bytes]) -> np.ndarray:
        """Of each word; each distinct one is spelled once, and those of up to ``LONGEST`` bytes are remembered."""
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        found = dict(zip(fresh, self.spelled(fresh).tolist(), strict=True)) if fresh else {}
        self.known.update((w, x) for w, x in found.items() if len(w) <= LONGEST)
        return np.fromiter((known if (known := self.known.get(w)) is not None else found[w] for w in words), np.float64, len(words))

    def spelled(self, words: list[bytes]) -> np.ndarray:
        cell, owner = trigrams(words)
        return np.bincount(owner, self.log_p[cell] - WITHIN[cell % KINDS], len(words))


class WindowNetwork:
    """``weights``: embeddings by place and class, hidden bias; weights and biases of clusters, and within each cluster."""

    SHAPES = ((len(AROUND), CLASSES, HIDDEN), (HIDDEN,), (HIDDEN, CLUSTERS), (CLUSTERS,), (CLUSTERS, HIDDEN, CLUSTERS), (CLUSTERS, CLUSTERS))

    def __init__(self, weights: list[np.ndarray]):
        self.w = weights

    @classmethod
    def beginning(cls, counts: np.ndarray, seed: int = 3, kind: type = np.float32) -> WindowNetwork:
        """Small random weights; the biases know how frequent the classes are."""
        rng = np.random.default_rng(seed)
        each = (counts + 0.5).reshape(CLUSTERS, CLUSTERS)
        w = [rng.normal(0, 0.2, s) for s in cls.SHAPES]
        w[1] = np.zeros(HIDDEN)
        w[3], w[5] = np.log(each.sum(axis=1)), np.log(each / each.sum(axis=1, keepdims=True))
        return cls([x.astype(kind) for x in w])

    @classmethod
    def from_flat(cls, flat: np.ndarray, kind: type = np.float32) -> WindowNetwork:
        sizes = [int(np.prod(s)) for s in cls.SHAPES]
        return cls([x.reshape(s).astype(kind) for x, s in zip(np.split(flat, np.cumsum(sizes)[:-1]), cls.SHAPES, strict=True)])

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.w])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        z = self.w[0][0].take(around[:, 0], axis=0)
        for k in range(1, len(AROUND)):
            z += self.w[0][k].take(around[:, k], axis=0)
        z += self.w[1]
        return np.tanh(z, out=z)

    def bound(self) -> float:
        """No score is larger, as hidden values are between -1 and 1."""
        return max(float((abs(w).sum(axis=-2) + abs(b)).max()) for w, b in (self.w[2:4], self.w[4:6]))

    def by_cluster(self, cls: np.ndarray) -> tuple[np.ndarray, Iterator[tuple[int, slice]]]:
        """The order that puts rows of a cluster together, and where in it each cluster is."""
        cluster = (cls // CLUSTERS).astype(np.uint8)
        ends = np.cumsum(np.bincount(cluster, minlength=CLUSTERS)).tolist()
        return np.argsort(cluster, kind="stable"), ((k, slice(a, b)) for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends, strict=True)) if a < b)

    def log_probability(self, around: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Of each class in its window."""
        order, clusters = self.by_cluster(cls)
        cluster, within = np.divmod(cls[order], CLUSTERS)
        h = self.hidden(around.take(order, axis=0))
        found, bound = np.empty(cls.size, h.dtype), self.bound()
        for lo in range(0, cls.size, COLUMNS):
            rows = slice(lo, lo + COLUMNS)
            found[rows] = exponentials(scores(self.w[2], self.w[3], h[rows]), cluster[rows], bound)[0]
        for k, rows in clusters:
            found[rows] += exponentials(scores(self.w[4][k], self.w[5][k], h[rows]), within[rows], bound)[0]
        out = np.empty_like(found)
        out[order] = found
        return out

    def gradients(self, around: np.ndarray, cls: np.ndarray) -> tuple[float, list]:
        """The mean loss and its gradients; those of the embeddings as (rows that are met, gradients) by place."""
        n = cls.size
        order, clusters = self.by_cluster(cls)
        around, (cluster, within) = around[order], np.divmod(cls[order], CLUSTERS)
        h, bound = self.hidden(around), self.bound()
        g = scores(self.w[2], self.w[3], h)
        loss = -softmax(g, cluster, bound).sum(dtype=np.float64)
        g[cluster, np.arange(n)] -= 1
        back = np.ascontiguousarray((self.w[2] @ g).T)
        inner, bias = np.zeros_like(self.w[4]), np.zeros_like(self.w[5])
        for k, rows in clusters:
            own = h[rows]
            gi = scores(self.w[4][k], self.w[5][k], own)
            loss -= softmax(gi, within[rows], bound).sum(dtype=np.float64)
            gi[within[rows], np.arange(own.shape[0])] -= 1
            back[rows] += (self.w[4][k] @ gi).T
            inner[k], bias[k] = (gi @ own).T, gi.sum(axis=1)
        back *= 1 - h * h
        places = []
        for k in range(len(AROUND)):
            order = np.argsort(around[:, k].astype(np.int16), kind="stable")  # of 16 bits, so by radix
            at = around[order, k]
            first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            places.append((at[first], np.add.reduceat(back.take(order, axis=0), first, axis=0) / n))
        return loss / n, [places, back.sum(axis=0) / n, (g @ h).T / n, g.sum(axis=1) / n, inner / n, bias / n]

    def train(self, around: np.ndarray, cls: np.ndarray, squares: list[np.ndarray]) -> float:
        """A step for each batch of windows, smaller where gradients were large before (``squares``)."""
        total = 0.0
        for lo in range(0, cls.size, BATCH):
            part = slice(lo, lo + BATCH)
            loss, grads = self.gradients(around[part], cls[part])
            total += loss * cls[part].size
            for k, (met, g) in enumerate(grads[0]):
                squares[0][k][met] += g * g
                self.w[0][k][met] -= RATE * g / np.sqrt(squares[0][k][met])
            for w, s, g in zip(self.w[1:], squares[1:], grads[1:], strict=True):
                s += g * g
                w -= RATE * g / np.sqrt(s)
        return total


def scores(weights: np.ndarray, bias: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of each class (a row) for each hidden vector."""
    z = weights.T @ h.T
    z += bias[:, None]
    return z


def exponentials(z: np.ndarray, at: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials in place; the logarithm of one share of each column, and the sum of each. ``bound``: no score is larger."""
    if bound > SAFE:
        z -= z.max(axis=0)
    own = z[at, np.arange(at.size)]
    total = np.exp(z, out=z).sum(axis=0)
    return own - np.log(total), total


def softmax(z: np.ndarray, at: np.ndarray, bound: float = np.inf) -> np.ndarray:
    """Columns to shares, in place; gives the logarithm of one share of each column."""
    found, total = exponentials(z, at, bound)
    z *= 1 / total
    return found


def windows(lists: list[list[bytes]], classes: Classes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes around each word, its own class, and the number of words of each text."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    n = int(sizes.sum())
    cls = np.fromiter(map(classes.__getitem__, chain.from_iterable(lists)), np.int32, n)
    owner = np.repeat(np.arange(sizes.size, dtype=np.int32), sizes)
    around = np.zeros((n, len(AROUND)), np.int16)
    for k, step in enumerate(AROUND):
        a, b = (slice(-step, None), slice(None, step)) if step < 0 else (slice(None, -step), slice(step, None))
        around[a, k] = np.where(owner[a] == owner[b], cls[b], 0)
    return around, cls, sizes


def trained(docs: DataFrame, classes: Classes, network: WindowNetwork) -> WindowNetwork:
    """The mean of the networks that tasks make of ``network`` on their own texts, weighted by their windows."""
    size = network.flat().size
    shared = docs.sparkSession.sparkContext.broadcast((classes, network.flat()))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_classes, flat = shared.value
        own = WindowNetwork.from_flat(flat)
        squares, seen = [np.full_like(x, 1e-6) for x in own.w], 0
        for _, texts in text_groups(batches, 0, 1 << 20):
            around, cls, _ = windows([split_words(t) for t in texts], own_classes)
            mixed = np.random.default_rng(cls.size).permutation(cls.size)
            own.train(around[mixed], cls[mixed], squares)
            seen += mixed.size
        if seen:
            yield to_blocks(np.append(np.round((own.flat() - flat).astype(np.float64) * UNIT) * seen, [seen]).astype(np.int64))
        release()

    total = block_sums(docs.select("text").mapInArrow(fit, "block int, sums binary"), size + 1)
    return WindowNetwork.from_flat(network.flat() + total[:-1] / max(1, total[-1]) / UNIT)


class Model:
    """All that scores a text."""

    def __init__(self, classes: Classes, network: WindowNetwork, spelling: Spelling, log_shares: np.ndarray):
        self.classes, self.network, self.spelling, self.log_shares = classes, network, spelling, log_shares

    def log_probabilities(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word of all texts given the words around it; and the number of words of each text."""
        lists = [split_words(t) for t in texts]
        around, cls, sizes = windows(lists, self.classes)
        out = np.empty(cls.size)
        for lo in range(0, cls.size, 8 * BATCH):
            part = slice(lo, lo + 8 * BATCH)
            out[part] = self.network.log_probability(around[part], cls[part])
        rare = np.flatnonzero(cls > OWN)
        if rare.size:
            flat = list(chain.from_iterable(lists))
            out[rare] += self.spelling.log_probability([flat[i] for i in rare.tolist()]) - self.log_shares[cls[rare] - OWN - 1]
        return out, sizes


def build_model(docs: DataFrame) -> Model:
    """Counts the words of ``docs`` (text), counts spellings, and trains the network."""
    words = vocabulary(docs)
    top = words.where(F.octet_length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(OWN).collect()
    classes = Classes({bytes(r.word): k for k, r in enumerate(top, 1)})

    def add_rare(total: np.ndarray, texts: list[bytes], n: pa.Array) -> None:
        n = n.to_numpy()
        cls = np.fromiter(map(classes.__getitem__, texts), np.int64, len(texts))
        np.add.at(total, KINDS**3 + cls, n)
        rare = np.flatnonzero(cls > OWN)
        if rare.size:
            cell, owner = trigrams([texts[i] for i in rare.tolist()])
            np.add.at(total, cell, n[rare][owner])

    counts = corpus_sum(words, KINDS**3 + CLASSES, add_rare, ["word", "n"])
    by_class = counts[KINDS**3 :]
    share = (by_class[1 + OWN :] + 0.5) / (by_class[1 + OWN :].sum() + 0.5 * ENDINGS)
    network = WindowNetwork.beginning(by_class)
    for _ in range(ROUNDS):
        network = trained(docs, classes, network)
    return Model(classes, network, Spelling(counts[: KINDS**3]), np.log(share))


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, mean_logprob, sum_logprob, n_tokens) for each row of ``docs`` (doc_id, text).

    Tokens are words between ASCII blanks, A-Z in lower case. Null and empty texts have no tokens, the sum 0 and a
    null mean. Repeated rows each count and get a row; a null doc_id stays null; other columns are not read. The
    model is trained on ``docs`` itself, on all of it.
    """
    model = docs.sparkSession.sparkContext.broadcast(build_model(docs))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_groups(batches, 1, 2 << 20):
            each, sizes = model.value.log_probabilities(texts)
            sums = np.zeros(sizes.size)
            full = np.flatnonzero(sizes)
            if full.size:
                sums[full] = np.add.reduceat(each, (np.cumsum(sizes) - sizes)[full])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sums), pa.array(sizes)], names=["doc_id", "sum_logprob", "n_tokens"])
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, sum_logprob double, n_tokens long")
    return rows.select("doc_id", F.when(F.col("n_tokens") > 0, F.col("sum_logprob") / F.col("n_tokens")).alias("mean_logprob"), "sum_logprob", "n_tokens")


def op6_masked_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
