import random

import numpy as np
import pytest

from hostlore.llm import seen_twice
from hostlore.llm import suffix_dedup as sd


def brute(rows):
    first = {}
    for doc, text in rows:
        if doc is not None:
            body = (text or "").encode()
            for i in range(len(body) - 49):
                first[body[i : i + 50]] = min(doc, first.get(body[i : i + 50], doc))
    out = []
    for doc, text in rows:
        body = (text or "").encode()
        hit = np.zeros(len(body) + 1, int)
        if doc is not None:
            for i in range(len(body) - 49):
                if first[body[i : i + 50]] < doc:
                    hit[i : i + 50] = 1
        kept = bytes(b for b, h in zip(body, hit, strict=False) if not h)
        out.append((doc, len(body), int(hit.sum()), int((np.diff(np.concatenate([[0], hit])) == 1).sum()), kept))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(11)
    syllables = "the an er in ou ñe été tion ly".split()

    def prose(n):
        return "".join(rng.choice(syllables) + rng.choice(["", "", " "]) for _ in range(n))

    passages = [prose(40) for _ in range(6)]
    texts = [None, "", "short", "a" * 300, "a" * 120, "ab" * 200, "b" + "ab" * 100]
    for _ in range(60):
        texts.append("".join(rng.choice(passages) if rng.random() < 0.5 else prose(rng.randint(1, 60)) for _ in range(rng.randint(1, 6))))
    base = prose(400)
    for _ in range(25):
        chars = list(base)
        for at in rng.sample(range(len(chars)), rng.randint(0, 12)):
            chars[at] = rng.choice("xyzé")
        texts.append("".join(chars))
    texts += [texts[9]] * 4
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return [*zip(ids, texts, strict=True), (None, texts[10]), (5, passages[0] * 2), (5, passages[0] * 2)]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sd, "GROUP_BYTES", 4000)
    rows = corpus()
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string").repartition(4)
    out = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.dedup_strings(df).collect()), key=str)
    assert out == brute(rows)
    assert sd.dedup_strings(df.limit(0)).count() == 0


def test_matching_statistics():
    """Of the index's samples alone: what each place has in common with the suffix before it, up to 50 bytes."""
    rng = random.Random(3)
    bodies = ["".join(rng.choices("ab", k=rng.randint(50, 90))).encode() for _ in range(30)]
    bodies += [bodies[0][:60] + b"zz" + bodies[1][:30], bodies[0], b"a" * 90, b"a" * 70]
    text = np.frombuffer(b"\xff".join([*bodies, b""]), np.uint8)
    ends = np.flatnonzero(text == 255)
    room = ends[np.searchsorted(ends, np.arange(text.size))] - np.arange(text.size)
    index = sd.RunLengthIndex(text, room)
    assert index.lengths.sum() == text.size and (index.symbols[1:] != index.symbols[:-1]).all()
    near, match = index.matching_statistics()
    order, raw = sd.suffix_order(text)[0], text.tobytes()
    before = dict(zip(order[1:].tolist(), order[:-1].tolist(), strict=True))

    def alike(a, b):
        n = 0
        while n < min(room[b], sd.DEPTH) and raw[a + n : a + n + 1] == raw[b + n : b + n + 1]:
            n += 1
        return n

    for b, a in before.items():
        n = alike(a, b)
        assert min(match[b], sd.LENGTH) == min(n, sd.LENGTH)
        assert n < sd.LENGTH or alike(near[b], b) >= sd.LENGTH


@pytest.mark.parametrize("seed", range(12))
def test_covered_strings(seed):
    """Repetitive fragments over few letters, many of them equal for long, against all strings."""
    rng = random.Random(seed)
    base = ["".join(rng.choices("ab" if seed % 2 else "abcd", k=rng.randint(60, 84))) for _ in range(4)] + ["a" * 80, "ab" * 40]
    bodies = []
    for _ in range(60):
        x = rng.choice(base)
        y = rng.choice(base)
        cut = rng.randint(0, len(x))
        bodies.append((x[:cut] + y[cut:])[rng.randint(0, 9) :].ljust(50, "a")[:84].encode())
    docs = np.array([rng.randint(0, 40) for _ in bodies])
    least = {}
    for b, d in zip(bodies, docs.tolist(), strict=True):
        for i in range(len(b) - 49):
            least[b[i : i + 50]] = min(d, least.get(b[i : i + 50], d))
    for b, d, got in zip(bodies, docs.tolist(), sd.covered_strings(bodies, docs), strict=True):
        assert got.tolist() == [least[b[i : i + 50]] < d for i in range(len(b) - 49)]


@pytest.mark.parametrize("bits", [0.01, 1])
def test_full_filters_change_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(seen_twice, "BITS_EACH", bits)
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.dedup_strings(df).collect()), key=str)
    assert out == brute(rows)


def test_edges_of_a_hot_passage_are_split(spark, monkeypatch):
    """A passage in all documents, between texts of their own: no bucket gets the edges of all of them."""
    monkeypatch.setattr(sd, "GROUP_BYTES", 300)
    monkeypatch.setattr(sd, "HOT", 20, raising=False)
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh ", k=90))
    rows = [(i, "".join(rng.choices("ijklmnop ", k=60)) + passage + "".join(rng.choices("qrstuvwx ", k=60))) for i in range(300)]
    plain = sd.settle_bucket

    def bounded(groups):
        settle = plain(groups)

        def settle_rows(part):
            if part.column("bucket")[0].as_py() >= 0:
                held = sum(int(sd.unpacked(x, sd.META)["size"].sum()) for x in part.column("meta").to_pylist())
                assert held < 10_000, f"bucket of {held} bytes"
            return settle(part)

        return settle_rows

    monkeypatch.setattr(sd, "settle_bucket", bounded)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.dedup_strings(df).collect()), key=str)
    assert out == brute(rows)


def test_very_long_texts(spark):
    """Texts of some hundred kilobytes that share a long passage, and one that repeats itself."""
    rng = random.Random(5)
    long = "".join(rng.choices("abcdefghij \n", k=200_000))
    rows = [(3, long), (1, "x" + long[50_000:150_000] + "y" * 500), (2, long[:1000] * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in sd.dedup_strings(df).collect()), key=str)
    assert out == brute(rows)


def test_fragments_without_repeated_strings_are_not_indexed(monkeypatch):
    """A bucket's fragments that share an anchor but no whole string are set aside before the index, without a loss."""
    rng, anchor = random.Random(8), b"the anchor of it"
    noise = lambda n: bytes(rng.choice(b"abcdefgh ") for _ in range(n))
    shared = noise(20) + anchor + noise(20)
    bodies = [noise(34) + anchor + noise(34) for _ in range(200)] + [noise(5) + shared + noise(7), shared + noise(3), noise(9) + shared]
    meta = np.zeros(len(bodies), sd.META)
    meta["doc"] = meta["row"] = np.arange(len(bodies)) + 1
    meta["size"], meta["anchor"] = [len(b) for b in bodies], 4
    indexed, index = [], sd.covered_strings
    monkeypatch.setattr(sd, "covered_strings", lambda some, docs: indexed.append(len(some)) or index(some, docs))
    table = sd.settle_bucket(1)(sd.pa.Table.from_batches([sd.as_batch([(0, sd.packed(b"".join(bodies)), sd.packed(meta))])]))
    spans = np.concatenate([sd.unpacked(x, sd.SPAN) for x in table.column("meta").to_pylist()])
    assert indexed == [3]
    assert sorted(spans.tolist()) == [(202, 202, 0, 56), (203, 203, 9, 65)]
    want = index(bodies, meta["doc"])
    assert [m.any() for m in want] == [False] * 201 + [True] * 2


def test_often_seen_hashes():
    often = np.array([3, 5, 9], np.uint64)
    asked = np.array([0, 3, 4, 5, 9, 10, 2**63], np.uint64)
    for some in (often, often[:1], often[:0]):
        assert seen_twice.TwiceSeen(np.zeros((1, 8), np.uint8), some).among_often(asked).tolist() == np.isin(asked, some).tolist()
    assert seen_twice.distinct(np.array([7, 2, 7, 2, 9], np.uint64)).tolist() == [2, 7, 9] and not seen_twice.distinct(often[:0]).size
