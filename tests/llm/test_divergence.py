import random
import re
from collections import Counter, defaultdict

import pytest

from hostlore.llm import divergence as dv

DOC = "doc_id long, text string, lang string, source string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_docs, top):
    groups, lang_docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        words = TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        groups[lang or "", source or ""].update(words)
        lang_docs[lang or ""].update(set(words))
    kept = {lang: sorted((t for t, n in c.items() if n >= min_docs), key=str.encode) for lang, c in lang_docs.items()}
    whole = defaultdict(Counter)
    for (lang, _), c in groups.items():
        whole[lang].update({t: c[t] for t in kept[lang]})

    def shares(c, lang):
        n = sum(c[t] for t in kept[lang])
        return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept[lang])) for t in kept[lang]}

    p = {g: shares(c, g[0]) for g, c in groups.items()}
    out = []
    for (lang, source), own in p.items():
        pairs = [(-sum(abs(own[t] - p[lang, other][t]) for t in own), other.encode(), other) for x, other in p if x == lang and other != source]
        q = shares(whole[lang], lang)
        above = [(q[t] - own[t], t.encode(), t) for t in own if groups[lang, source][t] > 0 and own[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", above, top)):
            out += [(lang, source, part, item, -v, rank) for rank, (v, _, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 4))) for _ in range(150)]
    out = []
    for i in range(600):
        lang = rng.choice(["en", "en", "en", "de", None])
        source = "hot" if i % 3 == 0 else f"s{rng.randint(0, 30)}"
        out.append((i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(150)], k=rng.randint(0, 40))).title(), lang, source))
    out += [(600, None, "en", "silent"), (601, "", "en", None), (602, "12 34 !", "fr", "a"), (603, "only here", "fr", "b"), (604, None, "it", "alone"), out[0], out[0]]
    return out + [(605, "a " * 300_000, "en", "hot")]


def audited(spark, rows, **options):
    names = ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in dv.audit(spark.createDataFrame(rows, DOC), **options).select(names).collect())


@pytest.mark.parametrize("group_block, term_block", [(3, 7), (1, 1000), (100, 20)])
def test_equals_brute_force(spark, rows, group_block, term_block):
    assert audited(spark, rows, min_docs=8, top=5, group_block=group_block, term_block=term_block) == brute(rows, 8, 5)


def test_no_kept_terms(spark, rows):
    out = audited(spark, rows[:40], min_docs=1000)
    assert out == brute(rows[:40], 1000, 50) and {r[4] for r in out} == {0}


def test_counts_passed_on_early(spark, rows, monkeypatch):
    monkeypatch.setattr(dv, "HELD", 20)
    assert audited(spark, rows[:200], min_docs=5) == brute(rows[:200], 5, 50)


def test_empty_table_and_other_columns(spark):
    assert audited(spark, []) == []
    frame = spark.createDataFrame([(1, "a b", "en", "x", 1, "t"), (2, "b c", "en", "y", 1, "t")], DOC + ", n long, term string")
    assert [(r["source"], r["item"]) for r in dv.audit(frame, min_docs=1).where("part = 'pair'").orderBy("source").collect()] == [("x", "y"), ("y", "x")]


def test_shares_are_exact_for_large_counts(spark):
    n, whole = 7 * 10**14, 9 * 10**15 + 1
    row = spark.createDataFrame([(n, whole)], "n long, w long").select(dv.share(dv.F.col("n"), dv.F.col("w"))).first()
    assert row[0] == 1 + 10**9 * (n + 5) // whole
