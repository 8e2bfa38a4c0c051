"""Benchmark decontamination by an FM-index over each shard of the training documents.

A task takes documents of about ``shard_bytes`` of text as a shard and indexes its word sequence: suffix array,
Burrows-Wheeler transform, a wavelet matrix for ranks, and suffix positions sampled every ``SAMPLE`` words. All test
phrases are then searched backwards at once, their occurrences located by walking to the next sample, and the
occurrences of a document merged into spans of words. Words outside the benchmark's vocabulary are in no phrase, so
runs of words too short for the shortest phrase are left out of the index; nothing else is.

The benchmark is the stated query set. It is taken in blocks of about ``block_bytes`` of text (a longer item is a block of
its own), one pass of the shards each within one job, so what is broadcast at once is bounded: about ten bytes a byte of
text. Documents are never shuffled, and rows keep their columns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from hostlore.llm.common import free_name, releasing, table, text_groups

WINDOW = 13
SAMPLE = 8
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 4 << 20
#: A-Z to lower case, other ASCII but letters and digits to a space; bytes of longer characters stay.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def fold_words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Bits:
    """A bit vector with constant-time ranks."""

    def __init__(self, bits: np.ndarray):
        self.n = bits.size
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first i bits."""
        word = i >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """A wavelet matrix: rank of a symbol, or the symbol at a place, in one step per bit."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.depth = max(1, int(top).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        now = symbols
        for level in range(self.depth - 1, -1, -1):
            one = ((now >> level) & 1).astype(bool)
            self.levels.append((Bits(one), int(now.size - one.sum())))
            now = np.concatenate([now[~one], now[one]])

    def down(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1, zeros + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at i, and where ``down`` takes them."""
        symbol = np.zeros(i.shape, np.int64)
        for bits, zeros in self.levels:
            one, ones = bits.get(i).astype(bool), bits.rank(i)
            i = np.where(one, zeros + ones, i - ones)
            symbol = symbol << 1 | one
        return symbol, i


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling. Zeros are separators: each is a symbol of its own, in order of place, below all others."""
    n = text.size
    rank = np.cumsum(text == 0) - 1
    rank = np.where(text == 0, rank, text.astype(np.int64) + (rank[-1] + 1))
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1 if width < n else 0
        key = rank * (int(rank.max()) + n + 2) + second
        order = np.argsort(key, kind="stable")
        step = np.empty(n, np.int64)
        step[0] = 0
        step[1:] = key[order[1:]] != key[order[:-1]]
        fresh = np.empty(n, np.int64)
        fresh[order] = np.cumsum(step)
        rank, width = fresh, width * 2
        if rank[order[-1]] == n - 1 or width >= n:
            return order


class FmIndex:
    """Over word ids from 1 on, with zeros between sequences and at the end."""

    def __init__(self, text: np.ndarray):
        top = int(text.max())
        order = suffix_array(text)
        last = text[order - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=top + 1))]).astype(np.int64)
        self.wavelet = Wavelet(last, top)
        self.origin = self.wavelet.down(np.arange(top + 1), np.zeros(top + 1, np.int64))
        marked = (order % SAMPLE == 0) | (last == 0)
        self.marked = Bits(marked)
        self.samples = order[marked]
        self.top = top

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases, rows padded on the left with zeros."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.first[-1])
        for step in range(phrases.shape[1]):
            symbol = phrases[:, phrases.shape[1] - 1 - step].astype(np.int64)
            on = np.flatnonzero((step < lengths) & (lo < hi))
            if not on.size:
                break
            known = symbol[on] <= self.top
            hi[on[~known]] = lo[on[~known]]
            on = on[known]
            s = symbol[on]
            base = self.first[s] - self.origin[s]
            lo[on], hi[on] = base + self.wavelet.down(s, lo[on]), base + self.wavelet.down(s, hi[on])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix ranks."""
        at, steps, out = rows.copy(), np.zeros(rows.size, np.int64), np.empty(rows.size, np.int64)
        left = np.arange(rows.size)
        while left.size:
            done = self.marked.get(at[left]).astype(bool)
            ready = left[done]
            out[ready] = self.samples[self.marked.rank(at[ready])] + steps[ready]
            left = left[~done]
            symbol, down = self.wavelet.access(at[left])
            at[left] = self.first[symbol] + down - self.origin[symbol]
            steps[left] += 1
        return out


class Phrases:
    """The distinct windows of a block of benchmark items: rows of word ids padded on the left, and who has each."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        rows, owners = [np.zeros((0, window), np.int32)], [np.zeros(0, np.int32)]
        for k, (_, text) in enumerate(items):
            words = fold_words(text)
            if words:
                ids = np.fromiter((self.vocab.setdefault(w, len(self.vocab) + 1) for w in words), np.int32, len(words))
                own = np.concatenate([np.zeros(max(0, window - ids.size), np.int32), ids])
                rows.append(np.unique(np.lib.stride_tricks.sliding_window_view(own, window), axis=0))
                owners.append(np.full(len(rows[-1]), k, np.int32))
        rows, owners = np.concatenate(rows), np.concatenate(owners)
        self.rows, which = np.unique(rows, axis=0, return_inverse=True)
        self.lengths = (self.rows > 0).sum(axis=1)
        order = np.argsort(which.ravel(), kind="stable")
        self.owners, self.first = owners[order], np.searchsorted(which.ravel()[order], np.arange(len(self.rows) + 1))

    def owned(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each phrase of a list: its place in the list, and each item that has it."""
        size = self.first[phrases + 1] - self.first[phrases]
        at = np.repeat(self.first[phrases] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return np.repeat(np.arange(phrases.size), size), self.owners[at]


def shard_hits(words: np.ndarray, ends: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in a shard as (document, first word in it, phrase). ``ends``: words up to and with each document."""
    none = (np.empty(0, np.int64),) * 3
    if not phrases.lengths.size or not words.size:
        return none
    doc_of_break = np.zeros(words.size + 1, bool)
    doc_of_break[ends] = True
    known = words > 0
    starts = np.flatnonzero(known & (~np.concatenate([[False], known[:-1]]) | doc_of_break[:-1]))
    stops = np.flatnonzero(known & (~np.concatenate([known[1:], [False]]) | doc_of_break[1:])) + 1
    long = stops - starts >= phrases.lengths.min()
    starts, sizes = starts[long], (stops - starts)[long]
    if not starts.size:
        return none
    place = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int((sizes + 1).sum()), np.int64)
    inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    text[np.repeat(place, sizes) + inner] = words[np.repeat(starts, sizes) + inner]
    index = FmIndex(text)
    lo, hi = index.search(phrases.rows, phrases.lengths)
    count = hi - lo
    phrase = np.repeat(np.arange(count.size), count)
    at = index.locate(np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum()))
    run = np.searchsorted(place, at, "right") - 1
    word = starts[run] + at - place[run]
    doc = np.searchsorted(ends, word, "right")
    return doc, word - np.concatenate([[0], ends])[doc], phrase


MET = "spans: array<int>, items: array<string>"
VERDICT = f"n_words: long, n_hit: long, n_items: long, items_sha256: string, contaminated: boolean, {MET}"


def searcher(shared, into: str, keep: int, first: bool, last: bool, shard_bytes: int):
    """A pass over the documents for one block of phrases; the first makes, the last sums up the spans and items.

    Batches have ``keep`` columns that pass, then the text, then (but for the first) what was met so far.
    """

    def verdict(lists: list[list[bytes]], spans: list[list[int]], found: list[list[str]]) -> list[pa.Array]:
        hit, size = [sum(x[1::2]) - sum(x[::2]) for x in spans], [len(x) for x in lists]
        digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in found]
        return [
            pa.array(size, pa.int64()),
            pa.array(hit, pa.int64()),
            pa.array([len(x) for x in found], pa.int64()),
            pa.array(digest),
            pa.array([h > 0 and 20 * h >= n for h, n in zip(hit, size, strict=True)]),
        ]

    @releasing
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = shared.value
        get = phrases.vocab.get
        for part, texts in text_groups(batches, keep, shard_bytes):
            lists = [fold_words(t) for t in texts]
            ends = np.cumsum([len(x) for x in lists]).astype(np.int64)
            words = np.fromiter((i for x in lists for i in map(get, x, repeat(0))), np.int64, int(ends[-1]))
            doc, start, phrase = shard_hits(words, ends, phrases)
            met = [{"spans": [], "items": []}] * len(texts) if first else part.column(keep + 1).to_pylist()
            spans, found = [list(x["spans"]) for x in met], [set(x["items"]) for x in met]
            for d, s, e in zip(doc.tolist(), start.tolist(), (start + phrases.lengths[phrase]).tolist(), strict=True):
                spans[d] += [s, e]
            place, owner = phrases.owned(phrase)
            for d, k in np.unique(np.stack([doc[place], owner]), axis=1).T.tolist():
                found[d].add(phrases.names[k])
            spans, found = [merged(x) for x in spans], [sorted(x) for x in found]
            columns = [*([] if not last else verdict(lists, spans, found)), pa.array(spans, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))]
            names = [x.split(":")[0] for x in (VERDICT if last else MET).split(", ")]
            struct = pa.StructArray.from_arrays(columns, names=names)
            passing = list(range(keep if last else keep + 1))
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in passing), struct], names=[*(part.schema.names[k] for k in passing), into])

    return search


def merged(spans: list[int]) -> list[int]:
    """Sorted, disjoint spans from flat (start, stop) pairs."""
    out: list[int] = []
    for s, e in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def item_blocks(benchmark: DataFrame, block_bytes: int) -> int:
    return int((benchmark.agg(F.sum(F.octet_length(F.col("text").cast("binary")))).first()[0] or 0) // block_bytes) + 1


def searched(docs: DataFrame, benchmark: DataFrame, keep: list[str], into: str, window: int, shard_bytes: int, block_bytes: int) -> DataFrame:
    """The columns ``keep`` of ``docs`` and a struct ``into`` with the words, hits, items and verdict of each row."""
    spark = docs.sparkSession
    usable = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    items = usable.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("binary").alias("body"))
    blocks, text = item_blocks(usable, block_bytes), free_name(docs, "body")
    now = docs.select(*keep, F.col("text").alias(text))
    for i in range(blocks):
        first, last = i == 0, i == blocks - 1
        block = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i).collect()
        phrases = Phrases([(r["item"], bytes(r["body"])) for r in block], window)
        search = searcher(spark.sparkContext.broadcast(phrases), into, len(keep), first, last, shard_bytes)
        passing = now.schema.fields[: len(keep) if last else len(keep) + 1]
        now = now.mapInArrow(search, StructType([*passing, *StructType.fromDDL(f"`{into}` struct<{VERDICT if last else MET}>").fields]))
    return now


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its contaminated spans of words, the items met, and the verdict.

    Words are runs of letters, digits and non-ASCII characters, A-Z in lower case. A phrase is ``window``
    consecutive words of an item (item_id, text), or all words of a shorter one. ``contaminated`` when the hit words
    are a twentieth of the document's words or more. Null and empty texts have no words; items with a null id or text
    are left out; rows that repeat an item_id are one item; repeated documents each get their row, and a null doc_id
    stays null. Other columns are not read.
    """
    rows = searched(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), benchmark, ["doc_id"], "found", window, shard_bytes, block_bytes)
    return rows.select("doc_id", "found.*")


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns. Each row is judged on its own text."""
    into = free_name(docs, "found")
    return searched(docs, benchmark, docs.columns, into, window, SHARD_BYTES, BLOCK_BYTES).where(f"not `{into}`.contaminated").select(docs.columns)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans", "items")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS l, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS p
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 13 + 1, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM bw),
dw AS (
  SELECT doc_id, i, l, array_to_string(w[i:i + l - 1], ' ') AS p
  FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)),
hit AS (SELECT doc_id, i, dw.l, item FROM dw JOIN bw ON dw.p = bw.p AND dw.l = bw.l),
words AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS pos FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN its USING (doc_id)
"""
