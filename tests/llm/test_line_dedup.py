import random
import re
from collections import defaultdict

import pytest

from hostlore.llm import line_dedup, seen_twice

KEY = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")


def key_of(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), KEY.sub("", line))


def brute(rows, min_chars, min_docs):
    holders = defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key_of(line)) >= min_chars:
                holders[key_of(line)].add(doc)
    lost = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if doc is None or lost.get(key_of(x), doc) == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    pool = [f"line {i} with enough words to count as long {'é' * (i % 3)}" for i in range(12)]
    texts = [None, "", "\n", "\n\n", pool[0], pool[0].upper(), f"  {pool[0]}\t\r", "x" * 9, "日" * 20, "日" * 39 + "\n" + "日" * 40]
    for _ in range(60):
        lines = [
            rng.choice(
                [
                    rng.choice(pool),
                    f"\t{rng.choice(pool).upper()} \x0b",
                    "short",
                    "",
                    f"own line {rng.random()} that nobody else has at all",
                    "日" * 40,
                ]
            ) for _ in range(rng.randint(1, 9))
        ]
        texts.append("\n".join(lines))
    texts.append("\n".join(f"{pool[i % 12]}" for i in range(30_000)))
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    out = list(zip(ids, texts, strict=True))
    return [*out, (None, pool[0]), (None, None), out[20], out[20], (out[21][0], pool[1])]


@pytest.mark.parametrize(("bits", "bound"), [(12, 1 << 24), (0.05, 1 << 24), (12, 0), (0.05, 0)])
def test_against_brute_force(spark, rows, monkeypatch, bits, bound):
    """With roomy and with full filters, with and without the broadcast."""
    monkeypatch.setattr(seen_twice, "BITS_EACH", bits)
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", bound)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept_text string").repartition(3)
    for min_chars, min_docs in ((40, 5), (5, 2)):
        out = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df, min_chars, min_docs).collect()]
        order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
        assert sorted(out, key=order) == sorted(brute(rows, min_chars, min_docs), key=order)


@pytest.mark.parametrize("bound", [1 << 24, 0])
def test_other_columns_stay(spark, rows, monkeypatch, bound):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", bound)
    names = ["doc_id", "text", "kept_text", "n_lines", "n_dropped", "lost_id", "lost_keys", "own_id", "key"]
    df = spark.createDataFrame([(i, t, *"abcdefg") for i, t in rows], "doc_id int, text string, " + ", ".join(f"{n} string" for n in names[2:]))
    out = line_dedup.without_repeated_lines(df, "lines")
    assert out.columns == [*names, "lines"] and out.schema["doc_id"].dataType.simpleString() == "int"
    assert {tuple(r[n] for n in names[2:]) for r in out.collect()} == {tuple("abcdefg")}
    assert line_dedup.without_repeated_lines(df.limit(0), "lines").count() == 0
