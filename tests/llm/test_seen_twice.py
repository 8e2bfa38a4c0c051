import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from hostlore.llm import seen_twice


@pytest.fixture
def words():
    return lambda text: np.unique(np.array([xxhash.xxh3_64_intdigest(w) for w in text.split()], np.uint64))


@pytest.mark.parametrize(("segments", "group"), [(16, 1 << 25), (3, 200), (1, 1)])
def test_all_twice_seen_are_held(spark, words, monkeypatch, segments, group):
    """None that two rows have is missed, few others are held, and counts of frequent ones are exact in large groups."""
    monkeypatch.setattr(seen_twice, "LEAST_SEGMENTS", segments)
    monkeypatch.setattr(seen_twice, "GROUP_BYTES", group)
    rng = random.Random(3)
    texts = [" ".join(["all", *(f"w{rng.randrange(900)}" for _ in range(9)), f"own{i}"]) for i in range(300)] + [None, "", "all"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    twice = seen_twice.twice_seen(docs, words, 3300, often=250)
    have = Counter(w for t in texts for w in {*(t or "").split()})
    hashes = {w: np.array([xxhash.xxh3_64_intdigest(w)], np.uint64) for w in have}
    assert all(twice.holds(hashes[w])[0] for w, n in have.items() if n > 1)
    once = [w for w, n in have.items() if n == 1]
    assert sum(bool(twice.holds(hashes[w])[0]) for w in once) < 0.1 * len(once)
    if group > 1000:
        assert twice.often.tolist() == hashes["all"].tolist()


def test_empty(spark, words):
    twice = seen_twice.twice_seen(spark.createDataFrame([], "text string"), words, 0)
    assert not twice.holds(np.array([1, 2], np.uint64)).any() and not twice.holds(np.empty(0, np.uint64)).size
