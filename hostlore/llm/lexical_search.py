"""Ranked lexical search: pair-bound MaxScore over document shards.

1. Each task cuts its texts into shards of about ``SHARD_BYTES`` and inverts each: a row for each term of a shard with its
   documents and occurrences, and a row with the shard's document ids and lengths. Every document is in the index.
2. The weight of a term needs its number of documents in all shards; only terms of the queries are summed, in blocks of
   queries. A query's terms make a *chain* by falling weight.
3. For each shard and block the impact lists of the chains' terms are precomputed, with their maxima, and for each two
   neighbours of a chain their *pair list*: the documents that have both, with the largest joint impact of any of them.
4. At query time the bound of a chain's rest is the least sum that covers it by terms and disjoint pairs, where a pair
   costs its joint maximum, or the larger of both maxima if that is more. Terms at the end of a chain whose bound is under
   the floor are not essential: documents that have only those are never looked at. Other documents are dropped as soon as
   what they have and the bound of the rest is under the floor.
5. The first floor is the k-th best of all documents in pair lists, over all shards; each shard raises it by what it finds.
   A bound under the floor is strictly less than a score that k documents have, so no tie is lost.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from hostlore.llm.common import release, table, term_lists, terms_table, text_groups, written

K = 10
SHARD_BYTES = 16 << 20
SHARD_DOCS = 1 << 16
#: Text of the queries that are answered together; their terms and chains are broadcast.
BLOCK_BYTES = 1 << 20
#: Pair lists of a chain, from its beginning, whose documents make the first floor.
SEED_PAIRS = 6
#: Final ranks are taken of this many parts of a query's documents first.
PARTS = 16
WORDS = terms_table(range(0x30, 0x3A), range(0x41, 0x5B), range(0x61, 0x7B))
POSTINGS = "shard long, term binary, n long, total long, docs binary, counts binary"


def slices(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive runs of an array as a binary column, without a copy for each."""
    offsets = np.concatenate([[0], ends]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(values.tobytes())])


class Shard:
    """Documents of a shard as they are read."""

    def __init__(self, number: int):
        self.number, self.size = number, 0
        self.ids, self.lengths, self.terms, self.counts, self.each = [], [], [], [], []
        self.known: dict[bytes, int] = {}

    def add(self, doc_id: int, text: bytes) -> None:
        found: Counter = Counter()
        for words in term_lists(text, WORDS):
            found.update(words)
        if found:
            self.ids.append(doc_id)
            self.lengths.append(found.total())
            known = self.known
            self.terms += [known.setdefault(t, len(known)) for t in found]
            self.counts += found.values()
            self.each.append(len(found))
        self.size += len(text)

    def rows(self) -> pa.RecordBatch:
        term, counts = np.array(self.terms, np.int32), np.array(self.counts, np.int64)
        docs = np.repeat(np.arange(len(self.ids), dtype=np.uint16), self.each)
        order = np.argsort(term, kind="stable")
        n = np.bincount(term, minlength=len(self.known))
        ends = np.cumsum(n)
        total = np.add.reduceat(counts[order], np.concatenate([[0], ends[:-1]])) if len(n) else n
        own = [pa.array([np.array(x, np.int64).tobytes()], pa.binary()) for x in (self.ids, self.lengths)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(n) + 1, self.number), pa.int64()),
                pa.array([None, *self.known], pa.binary()),
                pa.array([len(self.ids), *n], pa.int64()),
                pa.array([sum(self.lengths), *total], pa.int64()),
                pa.concat_arrays([own[0], slices(docs[order], ends)]),
                pa.concat_arrays([own[1], slices(counts[order].astype(np.uint32), ends)]),
            ],
            names=["shard", "term", "n", "total", "docs", "counts"],
        )


def invert(shard_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        now = Shard(first)
        for part, texts in text_groups(batches, 0):
            for doc_id, text in zip(part.column(1).to_pylist(), texts, strict=True):
                now.add(doc_id, text)
                if now.size >= shard_bytes or len(now.ids) == SHARD_DOCS:
                    yield now.rows()
                    now = Shard(now.number + 1)
        if now.ids:
            yield now.rows()
        release()

    return run


def build_index(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The postings of all rows of ``docs`` (doc_id, text) with an id, by shard and term, written."""
    rows = docs.where("doc_id is not null").select("text", F.col("doc_id").cast("long"))
    return written(rows.mapInArrow(invert(shard_bytes), POSTINGS), "postings")


class Queries:
    """A block of queries: ids, chains of term numbers, the terms' weights, and the pairs of neighbours."""

    def __init__(self, ids: list, terms: list[set[bytes]], weights: dict[bytes, int]):
        self.ids = ids
        self.number = {t: i for i, t in enumerate(sorted(weights))}
        self.weights = np.array([weights[t] for t in sorted(weights)], np.int64)
        self.chains = [[self.number[t] for t in sorted((t for t in own if t in weights), key=lambda t: (-weights[t], t))] for own in terms]
        self.pairs: dict[tuple[int, int], int] = {}
        for chain in self.chains:
            for pair in zip(chain, chain[1:]):
                self.pairs.setdefault(pair, len(self.pairs))


def query_terms(text: bytes | None) -> set[bytes]:
    return {w for words in term_lists(text or b"", WORDS) for w in words}


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def measured(length: int, n_docs: int, all_terms: int) -> int:
    """How long a document is against the mean: 100 is as long."""
    return 10 + 90 * length * n_docs // all_terms


class Lists:
    """The impact lists of one shard, as ``packed`` wrote them."""

    FIELDS = (
        ("ids", np.int64),
        ("term_ends", np.int64),
        ("term_docs", np.uint16),
        ("impacts", np.int64),
        ("pair_ends", np.int64),
        ("pair_docs", np.uint16),
        ("joint", np.int64),
    )

    def __init__(self, row: dict):
        for name, kind in self.FIELDS:
            setattr(self, name, np.frombuffer(row[name], kind))
        begins = np.concatenate([[0], self.term_ends[:-1]])
        self.top = np.zeros(len(self.term_ends), np.int64)
        some = np.flatnonzero(self.term_ends > begins)
        if some.size:
            self.top[some] = np.maximum.reduceat(self.impacts, begins[some])

    def term(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.term_ends[i - 1] if i else 0, self.term_ends[i])
        return self.term_docs[at], self.impacts[at]

    def pair(self, i: int) -> np.ndarray:
        return self.pair_docs[self.pair_ends[i - 1] if i else 0 : self.pair_ends[i]]

    def bounds(self, chain: list[int], pairs: dict | None) -> list[int]:
        """The most that a document can have of each chain's rest; without ``pairs``, by the terms alone."""
        bound = [0] * (len(chain) + 1)
        for i in range(len(chain) - 1, -1, -1):
            bound[i] = int(self.top[chain[i]]) + bound[i + 1]
            if pairs is not None and i + 1 < len(chain):
                a, b = chain[i], chain[i + 1]
                bound[i] = min(bound[i], max(int(self.joint[pairs[a, b]]), int(self.top[a]), int(self.top[b])) + bound[i + 2])
        return bound

    def looked_up(self, docs: np.ndarray, term: int) -> np.ndarray:
        """The impact of a term in each of the sorted documents."""
        own, impacts = self.term(term)
        if not own.size:
            return np.zeros(len(docs), np.int64)
        at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        return np.where(own[at] == docs, impacts[at], 0)

    def seeds(self, chain: list[int], pairs: dict, k: int) -> np.ndarray:
        """The best scores among the documents in the chain's first pair lists."""
        lists = [self.pair(pairs[p]) for p in list(zip(chain, chain[1:]))[:SEED_PAIRS]]
        docs = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.uint16)
        if not docs.size:
            return np.zeros(0, np.int64)
        return np.sort(sum(self.looked_up(docs, t) for t in chain))[::-1][:k]

    def best(self, chain: list[int], pairs: dict | None, floor: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the ``k`` best documents that reach the floor, and how many impacts were looked at."""
        bound, floor = self.bounds(chain, pairs), max(floor, 1)
        essential = next(i for i in range(len(chain) + 1) if bound[i] < floor)
        score = np.zeros(len(self.ids), np.int64)
        looked = 0
        for t in chain[:essential]:
            docs, impacts = self.term(t)
            score[docs] += impacts
            looked += len(docs)
        docs = np.flatnonzero(score)
        score = score[docs]
        for i in range(essential, len(chain) + 1):
            if len(docs) >= k:
                floor = max(floor, int(np.partition(score, len(score) - k)[len(score) - k]))
            keep = score + bound[i] >= floor
            docs, score = docs[keep], score[keep]
            if not docs.size or i == len(chain):
                break
            score = score + self.looked_up(docs, chain[i])
            looked += len(docs)
        order = np.lexsort((self.ids[docs], -score))[:k]
        return self.ids[docs[order]], score[order], looked


LISTS = "shard long, " + ", ".join(f"{name} binary" for name, _ in Lists.FIELDS)


def pack_lists(queries: Queries, n_docs: int, all_terms: int):
    """One row for each shard of rows that are sorted by shard: impact lists of the block's terms, and its pair lists."""

    def one(shard: int, ids: np.ndarray, lengths: np.ndarray, own: dict[int, tuple[np.ndarray, np.ndarray]]) -> dict:
        long = np.array([measured(n, n_docs, all_terms) for n in lengths.tolist()], np.int64)
        docs, impacts, ends, at = [np.zeros(0, np.uint16)], [np.zeros(0, np.int64)], [], 0
        for i in range(len(queries.weights)):
            if i in own:
                d, tf = own[i]
                own[i] = d, queries.weights[i] * ((1_000_000_000 * tf) // (1000 * tf + 8 * long[d]))
                docs.append(d)
                impacts.append(own[i][1])
                at += len(d)
            ends.append(at)
        both, joint, pair_ends, at = [np.zeros(0, np.uint16)], np.zeros(len(queries.pairs), np.int64), [], 0
        for (a, b), number in queries.pairs.items():
            if a in own and b in own:
                shared, x, y = np.intersect1d(own[a][0], own[b][0], assume_unique=True, return_indices=True)
                if shared.size:
                    joint[number] = (own[a][1][x] + own[b][1][y]).max()
                    both.append(shared)
                    at += len(shared)
            pair_ends.append(at)
        values = (ids, np.array(ends), np.concatenate(docs), np.concatenate(impacts), np.array(pair_ends), np.concatenate(both), joint)
        return {"shard": shard} | {name: v.astype(kind).tobytes() for (name, kind), v in zip(Lists.FIELDS, values, strict=True)}

    schema = pa.schema([("shard", pa.int64()), *((name, pa.binary()) for name, _ in Lists.FIELDS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, lengths, own = None, None, None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["shard"] != now:
                    if now is not None:
                        yield pa.RecordBatch.from_pylist([one(now, ids, lengths, own)], schema)
                    now, own = row["shard"], {}
                if row["term"] is None:
                    ids, lengths = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["counts"], np.int64)
                else:
                    own[queries.number[row["term"]]] = np.frombuffer(row["docs"], np.uint16), np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        if now is not None:
            yield pa.RecordBatch.from_pylist([one(now, ids, lengths, own)], schema)
        release()

    return run


def seed_scores(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, held = shared.value, {}
        for batch in batches:
            for row in batch.to_pylist():
                lists = Lists(row)
                for q, chain in enumerate(queries.chains):
                    if (found := lists.seeds(chain, queries.pairs, k)).size:
                        held[q] = np.sort(np.concatenate([held.get(q, found[:0]), found]))[::-1][:k]
        if held:
            sizes = [len(x) for x in held.values()]
            columns = [np.repeat(list(held), sizes), np.concatenate(list(held.values()))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query", "score"])

    return run


def shard_best(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, floors = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                lists, found = Lists(row), []
                for q, chain in enumerate(queries.chains):
                    ids, scores, _ = lists.best(chain, queries.pairs, floors.get(q, 1), k)
                    found += [(q, d, s) for d, s in zip(ids.tolist(), scores.tolist(), strict=True)]
                if found:
                    columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, names=["query", "doc_id", "score"])

    return run


def topmost(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first ``k`` rows of each query, of parts first, so that a query's rows don't all meet in one task."""
    part = Window.partitionBy("query", "part").orderBy(*order)
    rows = rows.withColumn("part", F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS))).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return rows.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of ``index`` for each item (item_id, text), by score above 0.

    Terms are runs of digits, letters and non-ASCII characters, A-Z in lower case; a query has each of its terms once.
    Null and empty texts have none, so items with such texts have no rows; rows that repeat an item_id are one item with
    the terms of all. Rows of documents that repeat a doc_id are ranked each; those without an id are not indexed. Equal
    scores rank by doc_id, and repeated rows in either order. Empty tables give no rows. Other columns are not read.
    """
    spark = index.sparkSession
    n_docs, all_terms = index.where("term is null").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    usable = items.select("item_id", F.col("text").cast("binary").alias("body")).where("body is not null")
    size = usable.agg(F.sum(F.octet_length("body"))).first()[0] or 0
    blocks = size // block_bytes + 1
    kind = items.schema["item_id"].dataType
    out = spark.createDataFrame([], StructType([StructField("item_id", kind), *StructType.fromDDL("rank int, doc_id long, score long").fields]))
    for i in range(blocks):
        terms: dict = {}
        for row in usable.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i).toLocalIterator():
            terms.setdefault(row["item_id"], set()).update(query_terms(row["body"]))
        asked = spark.createDataFrame([(t,) for t in sorted(set().union(*terms.values()))], "term binary")
        lists = index.join(F.broadcast(asked), "term", "left_semi")
        found = {bytes(r["term"]): r["df"] for r in lists.groupBy("term").agg(F.sum("n").alias("df")).collect()}
        weights = {t: w for t, df in found.items() if (w := weight(n_docs, df)) > 0}
        if not weights:
            continue
        queries = Queries(list(terms), list(terms.values()), weights)
        used = spark.createDataFrame([(t,) for t in sorted(weights)], "term binary")
        wanted = index.join(F.broadcast(used), "term", "left_semi").unionByName(index.where("term is null")).select("shard", "term", "docs", "counts")
        packed = wanted.repartition("shard").sortWithinPartitions("shard").mapInArrow(pack_lists(queries, n_docs, all_terms), LISTS)
        packed = written(packed, "impact-lists")
        seeds = packed.mapInArrow(seed_scores(spark.sparkContext.broadcast(queries), k), "query long, score long")
        floors = {r["query"]: r["score"] for r in topmost(seeds, k, F.desc("score")).where(F.col("rank") == k).collect()}
        best = packed.mapInArrow(shard_best(spark.sparkContext.broadcast((queries, floors)), k), "query long, doc_id long, score long")
        ranked = topmost(best, k, F.desc("score"), F.col("doc_id"))
        ids = spark.createDataFrame(list(enumerate(queries.ids)), StructType([StructField("query", LongType()), StructField("item_id", kind)]))
        out = out.unionByName(ranked.join(F.broadcast(ids), "query").select("item_id", "rank", "doc_id", "score"))
    return out


def op11_pair_bound_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents WHERE doc_id IS NOT NULL),
b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
z AS (SELECT count(*) AS n_docs, sum(len(w)) AS l FROM d WHERE len(w) > 0),
t AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS term FROM d),
tf AS (SELECT r, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM b) GROUP BY r, term),
wt AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, z GROUP BY term, n_docs),
s AS (
  SELECT item_id, r, any_value(doc_id) AS doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // l)))) AS score
  FROM b JOIN tf USING (term) JOIN wt USING (term), z GROUP BY item_id, r),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, CAST(score AS BIGINT) AS score FROM k WHERE rank <= 10
"""
