import base64
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece

from hostlore.llm import fertility

LINE = "The quick brown fox jumps over the lazy dog near old river bank"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    hit = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n


def test_rules(spark):
    texts = [
        None,
        "",
        "one",
        "a\x1cb\x85c d",
        f"{LINE}\n" * 2,
        f"{LINE} " * 40,
        "日本語 " * 30,
        f"{LINE} {LINE[::-1]} $$$ ### <b>",
        "\n \n \n\t\n",
        "ж" * 5000,
        f"{LINE}. Ñandú écoute. " + " ".join(LINE[i % 30 : i % 30 + 9].replace(" ", "e") for i in range(25)),
        *[f"{LINE} and something else that is not the same {i}" for i in (1, 1)],
    ]
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    out = {r.doc_id: r for r in fertility.apply_rules(rows).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for i, t in enumerate(texts):
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
        tokens = [x for w in re.findall(r"[^\x20\x09-\x0D]+", t or "") for x in model.encode(w)]
        if tokens:
            p = np.array(list(Counter(tokens).values())) / len(tokens)
            assert np.isclose(r.token_entropy, -(p * np.log2(p)).sum()) and np.isclose(r.chars_per_token, brute(t)[1] / len(tokens))
            assert np.isclose(r.fallback_share, np.mean([model.is_byte(x) for x in tokens]))
        assert not (r.base_failed and r.kept)
    assert out[10].kept and out[10].script == "latin" and out[6].script == "han" and out[9].script == "cyrillic"
    assert fertility.apply_rules(rows.limit(0)).count() == 0
    strict = {"latin": fertility.Band(50, 60, 0, 0, 1)}
    assert not any(r.kept for r in fertility.apply_rules(rows, bands=strict).collect() if r.script == "latin")


WORDS = """the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you
were all her she there would their we him been has when who will no more if out so up said what its about than into them can only
other time new some could these two may first then do any like my now over such our man me even most made after also did many off
before must well back through years much where your way down should because long each just state those people too mister little
good world make very year still see work life great home under water house street morning garden window letter river mountain""".split()


def test_bands_reject_what_the_base_rules_do_not(spark):
    """Junk of every kind goes by a band of its group, never by a base rule; clean documents stay."""
    rng = random.Random(6)
    clean = [" ".join(rng.choices(WORDS, k=rng.randint(90, 110))) for _ in range(300)]
    blobs = [" ".join(base64.b64encode(rng.randbytes(60)).decode() for _ in range(25)) for _ in range(3)]
    gibberish = [" ".join("".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randint(3, 9))) for _ in range(40)) for _ in range(3)]
    foreign = ["".join(c + "\u0306\u0328" if c.isalpha() and rng.random() < 0.3 else c for c in t) for t in clean[:3]]
    drone = [" ".join(rng.choice(["yes", "no", "yes yes"]) + rng.choice([",", ".", "!", ""]) for _ in range(70)) for _ in range(3)]
    junk = [*blobs, *gibberish, *foreign]
    texts = [*clean, *junk, *drone]
    rows = spark.createDataFrame([(i, t, "kept", i) for i, t in enumerate(texts)], "doc_id long, text string, rules string, `bands` long")
    out = {r.doc_id: r for r in fertility.apply_rules(rows).collect()}
    assert sum(out[i].kept for i in range(len(clean))) >= 0.99 * len(clean)
    for i in range(len(clean), len(clean) + len(junk)):
        assert not out[i].kept and not out[i].base_failed and out[i].rejected_by not in (None, "base"), texts[i][:80]
    assert all(out[i].rejected_by for i in range(len(clean) + len(junk), len(texts)))
    good = fertility.keep_good(rows)
    assert good.columns == rows.columns
    assert {r.doc_id: r for r in good.collect()} == {i: r for i, r in ((r.doc_id, r) for r in rows.collect()) if out[i].kept}


def test_keep_good_judges_rows_not_ids(spark):
    """Null and repeated doc_ids, repeated rows and odd column names: each row goes or stays by its own text."""
    text = " ".join(WORDS[:60])
    rows = spark.createDataFrame(
        [(None, text, 1), (None, "two words", 2), (7, text, 3), (7, "short", 4), (8, None, 5), (9, text, 6), (9, text, 6)],
        "doc_id long, text string, rules int",
    )
    assert sorted(r.rules for r in fertility.keep_good(rows).collect()) == [1, 3, 6, 6]
    assert fertility.keep_good(rows.limit(0)).columns == rows.columns


def test_words_are_spelled_alone():
    """Words spelled in one call, blanks outside ASCII in them or not, are those spelled one by one."""
    words = ["a", "\u00a0x", "x\u00a0", "\u3000", "y", "don't", "é", "日本語", "\x1c", "1234", "!!", "z\x85", "\x85z", "b"]
    for path in fertility.paths(None):
        v = fertility.load_vocabulary(path)
        tokens, sizes = v.encode(words)
        cut = np.split(tokens, np.cumsum(sizes)[:-1])
        assert [c.tolist() for c in cut] == [v.encode([w])[0].tolist() for w in words] and len(tokens) == sum(sizes)


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(fertility, "CACHE_WORDS", 3)
    s = fertility.Speller(fertility.paths(None))
    for words in ([b"a", b"bc", b"the"], [b"x", b"the"], [b"the", b"ing", b"the"]):
        ids = s.numbers([words])[0]
        for one in s.spellings:
            assert one.spell(ids).tolist() == [t for w in words for t in one.vocabulary.encode([w.decode()])[0].tolist()]
        assert len(s.number) <= 5


def test_very_long_and_repeated_rows(spark):
    rng = random.Random(1)
    long = " ".join(rng.choices(WORDS, k=200_000))
    rows = spark.createDataFrame([(1, long), (1, long), (None, long), (2, "x" * 400_000)], "doc_id long, text string")
    out = fertility.apply_rules(rows).collect()
    assert len(out) == 4 and len({(r.n_words, r.kept, r.token_entropy) for r in out if r.doc_id != 2}) == 1
    assert [r.n_words for r in out if r.doc_id == 2] == [1] and sum(r.doc_id is None for r in out) == 1
