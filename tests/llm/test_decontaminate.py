import hashlib
import random
import re

import numpy as np
import pytest

from hostlore.llm import decontaminate

VOCAB = [f"w{i}" for i in range(60)] + ["Ünï", "日本", "x1"]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    """(doc_id, n_words, n_hit, item ids) of each row."""
    phrases = {}
    for item, text in items:
        own = words(text)
        if item is not None and own:
            for i in range(max(1, len(own) - window + 1)):
                phrases.setdefault(tuple(own[i : i + window]), set()).add(str(item))
    out = []
    for doc, text in docs:
        own, hit, met = words(text), set(), set()
        for p, who in phrases.items():
            for i in range(len(own) - len(p) + 1):
                if tuple(own[i : i + len(p)]) == p:
                    hit.update(range(i, i + len(p)))
                    met |= who
        out.append((doc, len(own), len(hit), ",".join(sorted(met))))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(2)
    items = [
        ("b", " ".join(rng.choices(VOCAB, k=30))),
        ("a", " ".join(rng.choices(VOCAB, k=13))),
        ("c", "w1 w2"),
        ("d", None),
        ("e", "..."),
        (None, "w3 w4"),
        ("f", "alone"),
        ("g", "w1 w2"),
    ]
    items += [(f"h{i}", " ".join(rng.choices(VOCAB, k=rng.randint(1, 40)))) for i in range(20)]
    items += [("b", " ".join(rng.choices(VOCAB, k=20)))]  # repeats an id
    docs = [
        (1, None),
        (2, ""),
        (3, "..., !"),
        (4, "ALONE!"),
        (5, items[0][1].upper()),
        (6, items[0][1].upper()),
        (None, items[1][1]),
        (7, "w1"),
        (8, "w1, W2; w1 w2 w1"),
    ]
    for i in range(60):
        own = rng.choices(VOCAB, k=rng.randint(0, 120))
        if i % 3 == 0:
            source = words(rng.choice(items)[1] or "none")
            at = rng.randint(0, len(own))
            own[at:at] = source[rng.randint(0, len(source) // 2) :]
        docs.append((100 + i, rng.choice([" ", "\n", "-"]).join(own)))
    docs.append((200, " ".join(rng.choices(VOCAB[:3], k=20_000)) + " " + items[0][1]))
    docs.append((5, "another text under a repeated id"))
    return docs, items


@pytest.mark.parametrize(("window", "block", "shard"), [(13, 1 << 20, 1 << 20), (13, 300, 2000), (5, 1500, 400)])
def test_against_brute_force(spark, case, window, block, shard):
    docs, items = case
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, found string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, doc_id int")
    assert decontaminate.item_blocks(bench, block) == 1 or block < 1 << 20
    out = decontaminate.find_contamination(df, bench, window, shard, block).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    got = sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in out), key=key)
    assert got == sorted(brute(docs, items, window), key=key)
    for r in out:
        assert r.items_sha256 == hashlib.sha256(",".join(r["items"]).encode()).hexdigest() and r.n_items == len(r["items"])
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
        assert sum(r.spans[1::2]) - sum(r.spans[::2]) == r.n_hit


def test_empty_tables(spark, case):
    docs, items = case
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert decontaminate.find_contamination(df.limit(0), bench).count() == 0
    assert {(r.n_hit, r.n_items, r.contaminated) for r in decontaminate.find_contamination(df, bench.limit(0)).collect()} == {(0, 0, False)}


def test_clean_documents_judges_rows(spark):
    """Null and repeated ids and columns with the names used inside."""
    item = " ".join(VOCAB[:20])
    df = spark.createDataFrame([(None, item, 1), (None, "fine", 2), (5, item, 3), (5, "fine", 4), (6, None, 5)], "doc_id long, text string, found int")
    bench = spark.createDataFrame([("i", item)], "item_id string, text string")
    clean = decontaminate.clean_documents(df.withColumn("body", df.found), bench)
    assert clean.columns == ["doc_id", "text", "found", "body"] and sorted(r.found for r in clean.collect()) == [2, 4, 5]


def test_index_finds_and_locates():
    rng = np.random.default_rng(0)
    text = np.append(rng.integers(1, 4, 500), 0)
    index = decontaminate.FmIndex(text)
    for p in ([1], [2, 3], [1, 1, 2], [3, 3, 3, 3]):
        lo, hi = index.search(np.array([p]), np.array([len(p)]))
        want = [i for i in range(500 - len(p) + 1) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want
