"""Token counts and packing against the library itself."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from hostlore.llm import packing, token_counts, transducer

ODD = [
    "'s",
    "''s",
    "x'll",
    "x'lx",
    "a  b",
    " 's",
    "  's",
    "\n's",
    "\n\n's",
    "don't'",
    "'re're",
    "'r e'",
    "'",
    "'l",
    "'r",
    "'r\n",
    "   ",
    "a   ",
    "a \n",
    "Σας ΣΑΣ",
    "é é",
    "<|endoftext|> x",
    "12345 a1b2",
    "İx",
    "　日本語 テスト",
    "\x1c\x85\xa0x",
    "",
    "aaaa" * 50,
]


def mixed(n: int) -> list[str]:
    rng = random.Random(5)
    alphabet = [chr(c) for c in range(0x250)] + list("  \n\n''strvlemd<|") * 40
    return ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_machine_equals_library(name):
    machine = transducer.Compiled(public_tokenizers.path(name))
    library = Tokenizer.from_file(public_tokenizers.path(name))
    texts = ODD + mixed(800)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in machine.ids(texts)] == want
    assert machine.counts(texts).tolist() == [len(x) for x in want]


@pytest.mark.parametrize("words", [False, True])
def test_chunks_compose(words):
    rng = np.random.default_rng(3)
    kinds = rng.integers(0, len(transducer.KINDS) - 1, 5000).astype(np.uint8)
    nxt, _ = transducer.splitter(words)
    state, want = 0, []
    for k in kinds:
        want.append(state)
        state = nxt[state, k]
    for lanes in (1, 7, 64):
        assert transducer.run_splitter(kinds, nxt, lanes).tolist() == want


def test_table_starts_anew(monkeypatch):
    monkeypatch.setattr(transducer, "MAX_STATES", 50)
    machine = transducer.Compiled(public_tokenizers.path("byte_bpe_50k.json"))
    texts = mixed(60)
    want = [len(e.ids) for e in machine.library.encode_batch(texts, add_special_tokens=False)]
    assert [int(machine.counts([t])[0]) for t in texts] == want


def all_unicode(n: int) -> list[str]:
    """Texts over all planes, in runs of one script, with what joins and cuts pieces between."""
    rng = random.Random(9)
    ranges = [
        (0x400, 0x530),
        (0x370, 0x400),
        (0x590, 0x700),
        (0x900, 0xA00),
        (0xE00, 0xE80),
        (0x300, 0x370),
        (0x2000, 0x2070),
        (0x2010, 0x2030),
        (0x3000, 0x3100),
        (0x4E00, 0x9FFF),
        (0xAC00, 0xD7A4),
        (0xFF00, 0xFFEF),
        (0x1F300, 0x1F700),
        (0x1D400, 0x1D800),
        (0x10400, 0x10450),
        (0x20000, 0x20100),
        (0x660, 0x66A),
        (0xE000, 0xE010),
        (0x250, 0xD800),
        (0xE000, 0x110000),
    ]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(1, 12)):
            lo, hi = rng.choice(ranges)
            text += "".join(chr(rng.randrange(lo, hi)) for _ in range(rng.randint(1, 6))) + rng.choice(
                ["", " ", "  ", "'s", "\n", "a", "1", "!", "\u2019s", "\u3000"]
            )
        out.append(text)
    return [*out, "Привет, мир — это «текст»", "日本語のテキスト。", "naïve café — “quotes” … 👩‍👩‍👧", "İstanbul ΑΣ", "e\u0301 A\u030a"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_all_of_unicode_without_the_library(name):
    machine = transducer.Compiled(public_tokenizers.path(name))
    texts = all_unicode(600)
    want = [e.ids for e in machine.library.encode_batch(texts, add_special_tokens=False)]

    class Only:
        """The vocabulary's pattern and normaliser, and nothing that encodes."""

        pre_tokenizer, normalizer = machine.library.pre_tokenizer, machine.library.normalizer

    machine.library = Only
    assert [x.tolist() for x in machine.ids(texts)] == want
    assert machine.counts(texts).tolist() == [len(x) for x in want]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("chunk", [1, 3, 8, 256])
def test_counting_maps_compose(monkeypatch, name, chunk):
    """Long pieces in chunks, some of which remember for long how they were entered."""
    monkeypatch.setattr(transducer, "CHUNK", chunk)
    machine = transducer.Compiled(public_tokenizers.path(name))
    rng = random.Random(1)
    texts = [
        "a" * 700,
        "ab" * 300,
        "x" * 1001 + " y",
        "".join(rng.choices("abcdefgh", k=900)),
        "internationalization" * 40,
        "=" * 333,
        "-=" * 200,
        "日" * 200,
        "é" * 333,
        "",
        "short words here",
    ]
    want = [e.ids for e in machine.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in machine.ids(texts)] == want
    assert machine.counts(texts).tolist() == [len(x) for x in want]


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(transducer, "BATCH_CHARS", 100)
    machine = transducer.Compiled(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["The quick  brown fox\n\n isn't " * 50, "x" * 1000, "", "a b"]
    assert [x.tolist() for x in machine.ids(texts)] == [e.ids for e in machine.library.encode_batch(texts, add_special_tokens=False)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, length int")


def test_counts_query(spark):
    texts = ODD + [None, "two words", "two words"]
    out = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, [(i, t, "x", 1) for i, t in enumerate(texts)])).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for i, t in enumerate(texts):
        assert (out[i].n_bytes, out[i].n_tokens, out[i].over_limit) == (
            len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 1024
        )
    assert token_counts.count_tokens(frame(spark, [])).count() == 0


def test_packing_round_trip(spark):
    rng = random.Random(7)
    texts = [
        " ".join(rng.choices(["the", "quick", "brown", "fox's", "1.5", "ñandú"], k=rng.choice([0, 1, 5, 90, 700, 6000]))) for _ in range(120)
    ] + [None, "", "same", "same"]
    rows = packing.pack_documents(frame(spark, [(i, t, "x", 1) for i, t in enumerate(texts)]).repartition(3)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, ids.size) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == ids.size
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
        padding += 0 if at & (at - 1) == 0 else 4096 - at
    assert padding < 0.002 * sum(r.length for r in rows)
    assert packing.pack_documents(frame(spark, [])).count() == 0


def test_class_bins_hold_fixed_counts():
    packer = packing.Packer(4096, 0)
    for i in range(40):
        packer.add(i, np.full(1365, i, np.uint32))
    assert {len([r for r in packer.rows if r[5] == s]) for s in {r[5] for r in packer.rows}} == {3}
