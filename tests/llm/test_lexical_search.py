import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from hostlore.llm import lexical_search as ls

ITEM = "item_id long, text string"
DOC = "doc_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    rows = [(i, Counter(terms(t))) for i, t in docs if i is not None]
    rows = [(i, c) for i, c in rows if c]
    n_docs, total = len(rows), sum(c.total() for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for i, c in rows:
            m = 10 + 90 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if s > 0:
                scored.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def searched(spark, docs, items, shard_bytes=ls.SHARD_BYTES, k=10, **options):
    index = ls.build_index(spark.createDataFrame(docs, DOC), shard_bytes)
    return sorted(tuple(r) for r in ls.search(index, spark.createDataFrame(items, ITEM), k, **options).select("item_id", "rank", "doc_id", "score").collect())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(i, text(rng.randint(1, 120))) for i in range(400)]
    docs += [(i, docs[7][1]) for i in range(400, 430)]  # ties beyond the last rank
    docs += [(430, None), (431, ""), (432, "!? ,"), (None, text(50)), (5, docs[5][1]), (433, "Word " * 50_000 + vocabulary[250].upper())]
    items = [(i, text(rng.randint(1, 40))) for i in range(30)] + [(30, None), (31, ""), (32, "zzzz yyyy"), (33, docs[7][1]), (3, text(9)), (34, "WORD")]
    return docs, items


@pytest.mark.parametrize("shard_bytes, block_bytes", [(1, 1 << 20), (2000, 200), (1 << 24, 1 << 20)])
def test_equals_brute_force(spark, corpus, shard_bytes, block_bytes):
    docs, items = corpus
    assert searched(spark, docs, items, shard_bytes, block_bytes=block_bytes) == brute(docs, items)


def test_fewer_ranks(spark, corpus):
    docs, items = corpus
    assert searched(spark, docs, items, 4000, k=3) == brute(docs, items, 3)


def test_empty_tables_and_other_columns(spark, corpus):
    docs, items = corpus
    assert searched(spark, [], items) == [] and searched(spark, docs, []) == []
    index = ls.build_index(spark.createDataFrame([(1, "a b", 3, "x")], DOC + ", score long, term string"))
    clash = spark.createDataFrame([(9, "b", 1, 2)], ITEM + ", rank int, query long")
    assert [r["doc_id"] for r in ls.search(index, clash).collect()] == [1]


def lists_of(spark, docs, items):
    """The impact lists of one shard with all documents, and the queries."""
    index = ls.build_index(spark.createDataFrame(docs, DOC).coalesce(1))
    rows = index.orderBy(*(["shard"])).collect()
    own = [r for r in rows if r["term"] is None]
    n_docs, total = sum(r["n"] for r in own), sum(r["total"] for r in own)
    asked = [ls.query_terms((t or "").encode()) for _, t in items]
    df = {bytes(r["term"]): r["n"] for r in rows if r["term"] is not None}
    weights = {t: ls.weight(n_docs, df[t]) for q in asked for t in q if t in df}
    queries = ls.Queries([i for i, _ in items], asked, weights)
    import pyarrow as pa

    used = [r.asDict() for r in rows if r["term"] is None or bytes(r["term"]) in weights]
    names = ["shard", "term", "docs", "counts"]
    batch = pa.RecordBatch.from_pydict({n: [r[n] for r in used] for n in names}, pa.schema([("shard", pa.int64()), *((n, pa.binary()) for n in names[1:])]))
    packed = list(ls.pack_lists(queries, n_docs, total)(iter([batch])))
    return queries, ls.Lists(packed[0].to_pylist()[0])


def test_pair_bounds_hold_and_are_tighter(spark, corpus):
    docs, items = corpus
    queries, lists = lists_of(spark, docs, items)
    tighter = 0
    for chain in queries.chains:
        alone, both = lists.bounds(chain, None), lists.bounds(chain, queries.pairs)
        rest = np.zeros(len(lists.ids), np.int64)
        for i in range(len(chain) - 1, -1, -1):
            docs_of, impacts = lists.term(chain[i])
            rest[docs_of] += impacts
            assert rest.max(initial=0) <= both[i] <= alone[i]
            tighter += both[i] < alone[i]
        floor = int(np.sort(rest)[::-1][:10].min(initial=0))
        with_pairs, without = lists.best(chain, queries.pairs, floor, 10), lists.best(chain, None, floor, 10)
        assert [x.tolist() for x in with_pairs[:2]] == [x.tolist() for x in without[:2]]
        assert with_pairs[2] <= without[2]
    assert tighter > 100


def test_terms_that_never_meet_are_skipped(spark):
    """Four terms of one weight, each in its own hundred documents: only two can count, so none is essential beside the fifth."""
    docs = [(i, f"x{i // 100} {'y' if i % 20 == 0 else 'z'}") for i in range(400)]
    queries, lists = lists_of(spark, docs, [(0, "x0 x1 x2 x3 y")])
    (chain,) = queries.chains
    floor = sorted(brute(docs, [(0, "x0 x1 x2 x3 y")]))[-1][3]
    with_pairs, without = lists.best(chain, queries.pairs, floor, 10), lists.best(chain, None, floor, 10)
    assert with_pairs[0].tolist() == without[0].tolist() == [20 * i for i in range(10)]
    assert with_pairs[2] < without[2]


def test_pair_lists_are_intersections(spark, corpus):
    docs, items = corpus
    queries, lists = lists_of(spark, docs, items)
    for (a, b), number in queries.pairs.items():
        x, y = (dict(zip(*(v.tolist() for v in lists.term(t)), strict=True)) for t in (a, b))
        assert lists.pair(number).tolist() == sorted(x.keys() & y.keys())
        assert lists.joint[number] == max((x[d] + y[d] for d in x.keys() & y.keys()), default=0)
