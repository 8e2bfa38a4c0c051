import random
import re

import numpy as np

from hostlore.llm import minhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 2]) for i in range(max(1, len(words) - 1))} if words else set()


def brute(rows):
    sets = {i: shingles(t) for i, t in rows if i is not None}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "TOGETHER", 3)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(4000)]
    texts = [None, "", " \n", "one", "ONE", "two words", "Two\twords"]
    base = rng.choices(vocab, k=120)
    for _ in range(40):  # near copies around one text, and a drifting chain
        words = list(base)
        for at in rng.sample(range(120), rng.randint(0, 8)):
            words[at] = rng.choice(vocab)
        texts.append(" ".join(words))
    chain = rng.choices(vocab, k=100)
    for _ in range(25):
        for at in rng.sample(range(100), 3):
            chain[at] = rng.choice(vocab)
        texts.append(" ".join(chain))
    texts += [" ".join(rng.choices(vocab[:30], k=80)) for _ in range(10)] + [texts[8]] * 5
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, t) for i, t in zip(order, texts, strict=True)] + [(None, texts[8])]
    df = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, component_id string, n int")
    out = minhash.near_duplicates(df, partners=1).collect()
    want = brute(rows)
    assert len(out) == len(rows)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    for size in (1, 5, 60, 900):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        assert (minhash.sketches([a]) != minhash.EMPTY).all()
    found = []
    for _ in range(30):
        pool = np.unique(rng.integers(0, 2**63, 600).astype(np.uint64))
        rng.shuffle(pool)
        s = minhash.sketches([np.sort(pool[:500]), np.sort(pool[100:600])])
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - 400 / 600) < 0.03 and np.std(found) < 0.07


def test_repeated_ids(spark):
    rows = [(1, "a b c d e f"), (1, "k l m n o p"), (2, "a b c d e f"), (3, "k l m n o p")]
    out = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == 4 and {r.component_id for r in out} == {1}


def test_low_bytes_do_not_hide_a_pair(spark):
    """In band 0 only the low bytes of 2 and 3 agree; they really meet in band 1, where 1 is an unrelated smaller leader."""
    rng = np.random.default_rng(3)
    full = rng.integers(0, 2**63, (3, minhash.COORDINATES)).astype(np.uint64)
    full[2] = full[1]
    full[2, 0] ^= np.uint64(1 << 40)
    full[0, 4:] = full[1, 4:]
    full[0, 8:] = rng.integers(0, 2**63, minhash.COORDINATES - 8).astype(np.uint64)
    bands, low = minhash.band_keys(full), (full & np.uint64(255)).astype(np.uint8)
    assert bands[1, 0] != bands[2, 0] and (low[1] == low[2]).all() and len(set(bands[:, 1])) == 1
    known = spark.createDataFrame(
        [(i + 1, 100, bytearray(low[i].tobytes()), bands[i].tolist()) for i in range(3)],
        "doc_id long, n_shingles long, sketch binary, bands array<long>",
    )
    live = [(int(b), nth, i + 1, i + 1, i > 0, 1) for i in range(3) for nth, b in enumerate(bands[i].tolist()) if nth == 1]
    live = spark.createDataFrame(live, "band long, nth int, doc_id long, label long, asks boolean, blocks int")
    assert {(max(r.ask, r.other), min(r.ask, r.other)) for r in minhash.proposals(live, known, 80, 8).collect()} == {(3, 2)}


def test_set_links_are_exact(monkeypatch):
    monkeypatch.setattr(minhash, "COLUMNS", 16)
    rng = random.Random(8)
    sides = [[np.unique(np.array(rng.sample(range(60), rng.randint(1, 55)), np.uint64)) for _ in range(30)] for _ in range(2)]
    sides[1] += [s[: max(1, s.size - 3)] for s in sides[0]]
    want = {(i, k) for i, a in enumerate(sides[0]) for k, b in enumerate(sides[1]) if 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))}
    assert want and set(zip(*(x.tolist() for x in minhash.set_links(*sides, 80)), strict=True)) == want
    assert minhash.set_links([np.array([1], np.uint64)], [np.array([2], np.uint64)], 80)[0].size == 0


def test_joining_is_a_spanning_forest():
    a, b = np.array([1, 2, 3, 3, 9]), np.array([2, 3, 1, 2, 8])
    keep = minhash.joining(a, b)
    assert len(keep) == 3 and {9} <= set(a[keep])


def test_proposal_groups_are_bounded(spark, monkeypatch):
    """All of a bucket ask; no group has many more rows than two blocks, and every pair is proposed all the same."""
    n = 100
    full = np.random.default_rng(5).integers(0, 2**63, (1, minhash.COORDINATES)).astype(np.uint64)
    bands, low = minhash.band_keys(full)[0].tolist(), bytearray((full & np.uint64(255)).astype(np.uint8).tobytes())
    known = spark.createDataFrame([(i, 100, low, bands) for i in range(n)], "doc_id long, n_shingles long, sketch binary, bands array<long>")
    live = spark.createDataFrame([(bands[0], 0, i, i, True, 10) for i in range(n)], "band long, nth int, doc_id long, label long, asks boolean, blocks int")
    sizes, plain = [], type(known).mapInArrow

    def watched(df, *args, **kwargs):
        keys = [c for c in ("band", "block", "ask_block") if c in df.columns]
        sizes.extend(r["count"] for r in df.groupBy(*keys).count().collect())
        return plain(df, *args, **kwargs)

    monkeypatch.setattr(type(known), "mapInArrow", watched)
    found = {(max(r.ask, r.other), min(r.ask, r.other)) for r in minhash.proposals(live, known, 80, n).collect()}
    assert found == {(a, b) for a in range(n) for b in range(a)}
    assert max(sizes) < 60


def test_very_long_texts(spark):
    """A text of 60,000 words, a near copy of it, and one that shares too little."""
    rng = random.Random(2)
    words = [f"w{rng.randrange(30_000)}" for _ in range(60_000)]
    near = [w if rng.random() > 0.03 else "other" for w in words]
    far = [w if rng.random() > 0.2 else "another" for w in words]
    rows = [(5, " ".join(words)), (2, " ".join(near)), (3, " ".join(far)), (4, None)]
    out = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert out == {i: want[i][1] for i in out} and out[5] == 2 and out[3] == 3


def test_pairs_of_one_document_are_split(spark, monkeypatch):
    """A leader of many pairs has several groups, its text once in each; a doc_id of two texts links by either of them."""
    monkeypatch.setattr(minhash, "TOGETHER", 4)
    rng = random.Random(6)
    base, other = (rng.choices([f"w{i}" for i in range(500)], k=60) for _ in range(2))
    rows = [(0, " ".join(base)), (0, " ".join(other)), (0, " ".join(base))]
    for i in range(1, 60):
        words = list(other if i % 3 == 0 else base)
        for at in rng.sample(range(60), rng.randint(0, 9)):
            words[at] = "changed"
        rows.append((i, " ".join(words)))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = minhash.written(spark.createDataFrame([(i, 0) for i in range(1, 60)], "a long, b long"), "pairs")
    groups, plain = [], type(texts).mapInArrow

    def watched(df, *args, **kwargs):
        groups.extend(df.where("a is null").collect() + df.where("a is not null").collect())
        return plain(df, *args, **kwargs)

    monkeypatch.setattr(type(texts), "mapInArrow", watched)
    found = {r.a for r in minhash.verified(pairs, texts, 80, 2).collect()}
    sets = [(i, shingles(t)) for i, t in rows]
    want = {i for i, s in sets for k, t in sets if k == 0 and i and 100 * len(s & t) >= 80 * len(s | t)}
    assert found == want and 0 < len(want) < 59
    heads = [r for r in groups if r.a is None]
    assert len(heads) == 45 and len(groups) == 45 + 2 * 59  # 15 groups of three rows, of which two are equal; both versions meet all


def test_targets_go_where_somebody_asks(spark, monkeypatch):
    n, blocks = 100, 10
    full = np.random.default_rng(5).integers(0, 2**63, (1, minhash.COORDINATES)).astype(np.uint64)
    bands, low = minhash.band_keys(full)[0].tolist(), bytearray((full & np.uint64(255)).astype(np.uint8).tobytes())
    known = spark.createDataFrame([(i, 100, low, bands) for i in range(n)], "doc_id long, n_shingles long, sketch binary, bands array<long>")
    live = [(bands[0], 0, i, i, i == 7, blocks) for i in range(n)]
    live = spark.createDataFrame(live, "band long, nth int, doc_id long, label long, asks boolean, blocks int")
    rows, plain = [], type(known).mapInArrow

    def watched(df, *args, **kwargs):
        rows.append(df.count())
        return plain(df, *args, **kwargs)

    monkeypatch.setattr(type(known), "mapInArrow", watched)
    assert {(r.ask, r.other) for r in minhash.proposals(live, known, 80, n).collect()} == {(7, i) for i in range(n) if i != 7}
    assert rows == [n + blocks]
