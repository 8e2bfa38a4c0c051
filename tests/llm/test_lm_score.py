import random
import zlib
from collections import Counter

import numpy as np
import pytest

from hostlore.llm import lm_score as lm


def language(rng, n):
    """Sentences of a small grammar: word order is strict, words of a topic go together."""
    topics = [[f"{kind}{t}{i}" for i in range(12)] for t in range(4) for kind in ["noun"]]
    out = []
    for _ in range(n):
        topic = rng.choice(topics)
        words = []
        for _ in range(rng.randint(3, 8)):
            words += ["the", rng.choice(topic), rng.choice(["sees", "takes", "gives"]), "a", rng.choice(["small", "large", "old"]), rng.choice(topic), "."]
        out.append(" ".join(words))
    return out


def test_scores_equal_plain_sums(spark):
    """Counts, classes and sums by hand, with the network and spelling of the model itself."""
    texts = [
        "The cat sat on the mat",
        None,
        "",
        " \n",
        "the",
        "The cat sat on the mat",
        "a dog ran to the cat " * 20,
        "é" * 4000 + " the " + "x " * 3000,
        "the\tcat",
    ]
    df = spark.createDataFrame([(i, t, 9) for i, t in enumerate(texts)] + [(None, "the cat", 9)], "doc_id long, text string, n_tokens int")
    words = [(t or "").lower().encode().split() for t in [*texts, "the cat"]]
    counted = {bytes(r.word): r.n for r in lm.vocabulary(df).collect()}
    assert counted == Counter(w for x in words for w in x)
    model = lm.build_model(df)
    ranked = sorted((w for w in counted if len(w) <= lm.LONGEST), key=lambda w: (-counted[w], w))
    assert {w: k for w, k in model.classes.items() if k <= lm.OWN} == {w: k for k, w in enumerate(ranked[: lm.OWN], 1)}
    out = {r.doc_id: r for r in lm.score_documents(df).collect()}

    def cls(w):
        return model.classes.get(w) or 1 + lm.OWN + zlib.crc32(w[-2:]) % lm.ENDINGS

    for i, x in enumerate(words):
        r = out[i if i < len(texts) else None]
        c = [0, 0, *map(cls, x), 0, 0]
        around = np.array([[c[k], c[k + 1], c[k + 3], c[k + 4]] for k in range(len(x))], np.int64).reshape(-1, 4)
        want = model.network.log_probability(around, np.array(c[2:-2], np.int64)).astype(float).sum() if x else 0.0
        rare = [w for w in x if w not in model.classes]
        want += sum(model.spelling.log_probability([w])[0] - model.log_shares[cls(w) - lm.OWN - 1] for w in rare)
        assert r.n_tokens == len(x) and np.isclose(r.sum_logprob, want, rtol=1e-4, atol=1e-3)
        assert (r.mean_logprob is None) == (not x)
    assert np.isclose(out[0].sum_logprob, out[5].sum_logprob, rtol=1e-5)
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_probabilities_add_up():
    rng = np.random.default_rng(1)
    net = lm.WindowNetwork.beginning(rng.integers(0, 50, lm.CLASSES))
    every = np.arange(lm.CLASSES)
    for around in rng.integers(0, lm.CLASSES, (3, 4)):
        assert np.isclose(np.exp(net.log_probability(np.tile(around, (lm.CLASSES, 1)), every)).sum(), 1, atol=1e-3)
    spelling = lm.Spelling(rng.integers(0, 9, lm.KINDS**3))
    assert np.allclose(np.exp(spelling.log_p).reshape(-1, lm.KINDS).sum(axis=1), 1)


@pytest.mark.parametrize("part", range(6))
def test_gradients_are_numerical(part):
    rng = np.random.default_rng(2)
    net = lm.WindowNetwork.beginning(rng.integers(0, 50, lm.CLASSES), kind=np.float64)
    around, cls = rng.integers(0, 40, (300, 4)), rng.integers(0, 200, 300)
    loss, grads = net.gradients(around, cls)
    assert np.isclose(loss, -net.log_probability(around, cls).mean())
    full = np.zeros_like(net.w[part])
    if part == 0:
        for k, (met, g) in enumerate(grads[0]):
            full[k][met] = g
    else:
        full = grads[part]
    picked = rng.choice(np.flatnonzero(np.abs(full).ravel() > 1e-6), 12)
    for i in picked:
        at, step = np.unravel_index(i, full.shape), 1e-5
        net.w[part][at] += step
        up = -net.log_probability(around, cls).mean()
        net.w[part][at] -= 2 * step
        down = -net.log_probability(around, cls).mean()
        net.w[part][at] += step
        assert np.isclose((up - down) / 2 / step, full[at], rtol=1e-3, atol=1e-9)


def test_order_and_spelling_matter(spark):
    """Shuffled and corrupted texts score lower than the texts themselves."""
    rng = random.Random(4)
    train = language(rng, 3000)
    rare = [
        f"{rng.choice(['bor', 'tal', 'mer'])}{rng.choice(['ina', 'eto', 'ush'])}{rng.choice(['len', 'dor'])}{rng.choice('aeiou')}{rng.choice('rstn')}" for _ in range(
            1
        )
    ]
    own = language(rng, 60)
    shuffled = [" ".join(rng.sample(t.split(), len(t.split()))) for t in own]
    corrupted = [" ".join("".join(rng.choice("qxzjkv#%") if rng.random() < 0.3 else c for c in w) for w in t.split()) for t in own]
    rows = [(i, t) for i, t in enumerate([*own, *shuffled, *corrupted, *train, *rare])]
    out = {r.doc_id: r.mean_logprob for r in lm.score_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for at in (60, 120):
        assert sum(out[i] > out[at + i] for i in range(60)) >= 57


def test_every_place_trains(spark):
    """Words that are never at a fourth place are learned too."""
    docs = spark.createDataFrame([(" ".join(["aa bb cc dd"] * 60),)] * 40, "text string")
    model = lm.build_model(docs)
    each, _ = model.log_probabilities([b"aa bb cc dd " * 20])
    assert min(each[8:-8].reshape(-1, 4).mean(axis=0)) > model.log_probabilities([b"dd bb aa cc " * 20])[0].mean()


def test_a_training_step_takes_each_exponential_once(monkeypatch):
    """Of each window, one for each cluster and one for each class within its own; they were most of the work when taken twice."""
    rng, taken, exp = np.random.default_rng(5), [], np.exp
    net = lm.WindowNetwork.beginning(rng.integers(0, 50, lm.CLASSES))
    monkeypatch.setattr(np, "exp", lambda z, **kw: (taken.append(z.size), exp(z, **kw))[1])
    net.gradients(rng.integers(0, lm.CLASSES, (500, 4)), rng.integers(0, lm.CLASSES, 500))
    assert sum(taken) == 500 * 2 * lm.CLUSTERS


def test_small_scores_need_no_maximum():
    """Scores under SAFE are exponentiated as they are, larger ones less their maximum: the same shares both ways."""
    rng = np.random.default_rng(5)
    net = lm.WindowNetwork.beginning(rng.integers(0, 1000, lm.CLASSES))
    around, cls = rng.integers(0, lm.CLASSES, (5000, len(lm.AROUND))).astype(np.int16), rng.integers(0, lm.CLASSES, 5000)
    h = net.hidden(around)
    assert max(abs(lm.scores(net.w[2], net.w[3], h)).max(), *(abs(lm.scores(w, b, h)).max() for w, b in zip(net.w[4], net.w[5], strict=True))) <= net.bound() < lm.SAFE
    plain, found = net.log_probability(around, cls), {}
    for bound in (net.bound(), np.inf):
        z = lm.scores(net.w[2], net.w[3], h)
        found[bound] = lm.softmax(z, cls // lm.CLUSTERS, bound), z
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(*found.values(), strict=True))
    large = lm.WindowNetwork([w * 1000 for w in net.w])
    assert large.bound() > lm.SAFE and np.isfinite(large.log_probability(around, cls)).all() and np.isfinite(plain).all()


def test_a_word_is_spelled_once(monkeypatch):
    model = lm.Spelling(np.random.default_rng(6).integers(0, 50, lm.KINDS**3))
    words = [b"abc", b"xyz", b"abc", b"q" * 1000, b"abc", b"\xc3\xa9t", b"q" * 1000]
    want, asked, spelled = model.spelled(words), [], model.spelled
    monkeypatch.setattr(model, "spelled", lambda some: asked.append(some) or spelled(some))
    assert (model.log_probability(words) == want).all() and (model.log_probability(words) == want).all()
    assert asked == [[b"abc", b"xyz", b"q" * 1000, b"\xc3\xa9t"], [b"q" * 1000]]
    monkeypatch.setattr(lm, "CACHE_WORDS", 2)
    assert (model.log_probability(words) == want).all() and len(model.known) == 3
