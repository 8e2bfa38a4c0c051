"""Quality rules from tokenizer fertility.

Two public vocabularies, one with byte fallback and one of bytes made for many languages, spell each word alone. Per
document and vocabulary that gives characters per token, the share of single bytes outside ASCII among the tokens, and the
entropy of the token distribution. A document is held against others of its *group*: of the same script (that of most
of its letters) and, as entropy grows with length, of the same power of two of tokens. The bands of a group reach
``REACH`` interquartile ranges beyond the quartiles of all its documents, equal measures (copies) counted once; a document
outside any band is rejected. Groups of fewer than ``LEAST_DOCUMENTS`` have fixed, wide bands by script. No label or
language is needed, and all documents are measured: the quartiles come from counts of rounded values, so they are the
same in every run.

Four plain counts come along, of which too few words and too many words in repeated windows reject as well.

Measuring reads the documents once and shuffles no text; a task holds the spellings of at most ``CACHE_WORDS`` words, and
lets them go at its end.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from hostlore.llm.common import free_name, mix64, releasing, table, text_groups, written

VOCABULARY = "piece_bpe_32k.model"
SECOND = "byte_bpe_multi_50k.tiktoken"
CACHE_WORDS = 300_000
#: Text that is measured at once.
GROUP_BYTES = 4 << 20
BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Bands reach so many interquartile ranges beyond the quartiles; the range counts as this share of the median at least.
REACH = 2.5
LEAST_RANGE = 0.04
LEAST_DOCUMENTS = 100
#: Measures are rounded to 1 / GRID for the quartiles.
GRID = 512
#: Powers of two of tokens that have groups of their own; shorter and longer documents join the first and the last.
SIZE_CLASSES = (5, 16)


class Band(NamedTuple):
    """Bounds of characters per token, byte-fallback share and bits of entropy per token."""

    min_chars: float
    max_chars: float
    max_fallback: float
    min_entropy: float
    max_entropy: float


#: For small groups: wide enough for prose; scripts spelled letter by letter or byte by byte have bands of their own.
#: ``max_fallback`` holds for large groups as well, unless their quartiles allow more.
BANDS = {
    "latin": Band(1.3, 8.0, 0.15, 3.0, 12.0),
    "greek": Band(0.8, 6.0, 0.40, 3.0, 12.0),
    "cyrillic": Band(1.0, 8.0, 0.30, 3.0, 12.0),
    "han": Band(0.3, 2.5, 0.85, 3.0, 12.5),
    "other": Band(0.2, 8.0, 0.98, 2.5, 13.0),
}
#: Code points of the letters of each script; what has none of them, or more letters elsewhere, is "other".
SCRIPTS = {
    "latin": re.compile(r"[A-Za-zÀ-ɏḀ-ỿ]"),
    "greek": re.compile(r"[Ͱ-Ͽἀ-῿]"),
    "cyrillic": re.compile(r"[Ѐ-ԯ]"),
    "han": re.compile(r"[぀-ヿ㐀-鿿가-힯]"),
}
NOT_LETTERS = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))


def script_of(text: bytes) -> str:
    """The script of most letters; "other" without letters. ASCII letters that are over half of all bytes settle it."""
    if 2 * len(text.translate(None, NOT_LETTERS)) > len(text):
        return "latin"
    chars = text.decode()
    found = {name: len(p.findall(chars)) for name, p in SCRIPTS.items()}
    found["other"] = sum(c.isalpha() for c in chars) - sum(found.values())
    return max(found, key=found.get) if any(found.values()) else "other"


class Vocabulary(NamedTuple):
    """``encode`` spells a list of words, as all tokens and the number of each word's; ``is_byte`` tells which tokens are
    single bytes outside ASCII, which no longer token covers."""

    encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]
    is_byte: np.ndarray


def load_vocabulary(path: str) -> Vocabulary:
    """A sentencepiece ``.model`` or a ``.tiktoken`` file of ranks, which spells each word with a space before it."""
    if path.endswith(".tiktoken"):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        width = np.zeros(max(ranks.values()) + 1, np.int64)
        width[list(ranks.values())] = [len(x) for x in ranks]
        is_byte = np.zeros(width.size, bool)
        is_byte[[ranks[bytes([b])] for b in range(128, 256)]] = True

        def encode(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            """All at once: no piece of the pattern goes over a space that follows a character that isn't blank."""
            joined = "".join([f" {w}" for w in words])
            tokens = np.array(encoding.encode_ordinary(joined), np.int32)
            ends = np.cumsum([len(w) + 1 for w in words] if joined.isascii() else [len(w.encode()) + 1 for w in words])
            return tokens, np.diff(np.searchsorted(np.cumsum(width[tokens]), ends, "right"), prepend=0)

        def each(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            odd = [i for i, w in enumerate(words) if w.split() != [w]]  # blanks outside ASCII
            if not odd:
                return encode(words)
            cuts, parts = sorted({0, len(words), *odd, *(i + 1 for i in odd)}), []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                parts.append(encode(words[lo:hi]))
            return np.concatenate([t for t, _ in parts]), np.concatenate([n for _, n in parts])

        return Vocabulary(each, is_byte)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def pieces(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        spelled = model.encode(words, num_threads=1)
        sizes = np.fromiter(map(len, spelled), np.int64, len(words))
        return np.fromiter(chain.from_iterable(spelled), np.int32, int(sizes.sum())), sizes

    return Vocabulary(pieces, np.array([model.is_byte(i) for i in range(model.vocab_size())]))


class Spellings:
    """The tokens of numbered words in one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.known = 0
        self.tokens = np.empty(1 << 16, np.int32)
        self.first = np.zeros(1 << 16, np.int64)

    def add(self, words: list[str]) -> None:
        tokens, sizes = self.vocabulary.encode(words)
        base, n = self.known, len(words)
        end = int(self.first[base]) + tokens.size
        if end > self.tokens.size:
            self.tokens = np.concatenate([self.tokens, np.empty(end, np.int32)])
        if base + n + 1 > self.first.size:
            self.first = np.concatenate([self.first, np.zeros(base + n + 1, np.int64)])
        self.tokens[int(self.first[base]) : end] = tokens
        self.first[base + 1 : base + n + 1] = self.first[base] + np.cumsum(sizes)
        self.known += n

    def spell(self, numbers: np.ndarray) -> np.ndarray:
        first, size = self.first[numbers], self.first[numbers + 1] - self.first[numbers]
        return self.tokens[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


class Speller:
    """Numbers words and keeps their spellings in each vocabulary between batches."""

    def __init__(self, paths: list[str]):
        self.spellings = [Spellings(load_vocabulary(p)) for p in paths]
        self.number: dict[bytes, int] = {}

    def numbers(self, lists: list[list[bytes]]) -> list[np.ndarray]:
        """A number for each word, the same for equal words of one call."""
        known = self.number
        fresh = list({w for words in lists for w in words if w not in known})
        if known and len(known) + len(fresh) > CACHE_WORDS:
            known.clear()
            for s in self.spellings:
                s.clear()
            fresh = list({w for words in lists for w in words})
        if fresh:
            base, words = len(known), [w.decode() for w in fresh]
            for s in self.spellings:
                s.add(words)
            known.update(zip(fresh, range(base, base + len(fresh)), strict=True))
        return [np.fromiter(map(known.__getitem__, words), np.int64, len(words)) for words in lists]


def repeated_words(ids: np.ndarray, window: int = REPEAT_WINDOW) -> int:
    """Words in windows of ``window`` words that are in the text twice or more."""
    n = ids.size - window + 1
    if n < 2:
        return 0
    mixed, h = mix64(ids.astype(np.uint64) + np.uint64(1)), np.zeros(n, np.uint64)
    for k in range(window):
        h = h * np.uint64(0x9E3779B97F4A7C15) + mixed[k : k + n]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twin = np.zeros(n, bool)
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    at = np.flatnonzero(twin)
    rows = np.lib.stride_tricks.sliding_window_view(ids, window)[at]
    _, which, count = np.unique(rows, axis=0, return_inverse=True, return_counts=True)  # equal hashes, now equal words
    at = at[count[which.ravel()] > 1]
    edge = np.zeros(ids.size + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def repeated_lines(text: bytes) -> int:
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line in seen:
            n += 1
        elif line.strip(BLANKS):
            seen.add(line)
    return n


def measures(tokens: np.ndarray, is_byte: np.ndarray, chars: int) -> tuple[float, float, float]:
    """Characters per token, share of byte tokens, bits per token; zeros without tokens."""
    if not tokens.size:
        return 0.0, 0.0, 0.0
    s = np.sort(tokens)
    count = np.diff(np.concatenate([[-1], np.flatnonzero(s[1:] != s[:-1]), [s.size - 1]]))
    p = count / tokens.size
    return chars / tokens.size, float(is_byte[tokens].mean()), float(-(p * np.log2(p)).sum())


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MEASURES = ("chars_per_token", "fallback_share", "token_entropy")


def measure_fields(vocabularies: int) -> list[str]:
    """The measures of the first vocabulary have plain names, those of the others a number."""
    return [m if k == 0 else f"{m}_{k + 1}" for k in range(vocabularies) for m in MEASURES]


def measured(docs: DataFrame, keep: list[str], into: str, vocabularies: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` and a struct ``into``: counts, base verdict, script, size class, measures."""
    fields = measure_fields(len(vocabularies))
    kind = f"struct<{', '.join(f'{c}: long' for c in COUNTS)}, base_failed: boolean, script: string, size_class: int, " f"{', '.join(f'{m}: double' for m in fields)}>"
    schema = StructType([*(docs.schema[c] for c in keep), *StructType.fromDDL(f"`{into}` {kind}").fields])

    @releasing
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(vocabularies)
        for part, texts in text_groups(batches, len(keep), GROUP_BYTES):
            chars, out = pc.fill_null(pc.utf8_length(part.column(len(keep))), 0).to_pylist(), []
            for t, n_chars, ids in zip(texts, chars, speller.numbers([t.split() for t in texts]), strict=True):
                word_chars = n_chars - len(t) + len(t.translate(None, BLANKS))
                repeats = repeated_words(ids)
                failed = ids.size < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * ids.size
                spelled = [s.spell(ids) for s in speller.spellings]
                size_class = min(max(int(spelled[0].size).bit_length() - 1, SIZE_CLASSES[0]), SIZE_CLASSES[1])
                found = [x for s, tokens in zip(speller.spellings, spelled, strict=True) for x in measures(tokens, s.vocabulary.is_byte, word_chars)]
                out.append(
                    (
                        ids.size,
                        word_chars,
                        len(t) - len(t.translate(None, SYMBOLS)),
                        repeated_lines(t),
                        repeats,
                        failed,
                        script_of(t),
                        size_class,
                        *found,
                    )
                )
            columns = [pa.array(c, pa.int32()) if i == 7 else pa.array(c) for i, c in enumerate(zip(*out, strict=True))]
            struct = pa.StructArray.from_arrays(columns, names=[*COUNTS, "base_failed", "script", "size_class", *fields])
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], struct], names=[*keep, into])

    return docs.select(*keep, F.col("text").alias(free_name(docs, "text"))).mapInArrow(measure, schema)


def group_bands(rows: DataFrame, into: str, fields: list[str]) -> DataFrame:
    """(script, size_class, bands): for each group with documents enough, the bounds of each measure as structs.

    At most one row for each script and size class, whatever the corpus.
    """
    grid = rows.where(f"not `{into}`.base_failed").select(
        f"{into}.script", f"{into}.size_class", *(F.round(F.col(f"{into}.{m}") * GRID).cast("int").alias(m) for m in fields)
    )
    each = grid.distinct().unpivot(
        ["script", "size_class"], fields, "measure", "cell"
    ).groupBy("script", "size_class", "measure", "cell").agg(F.count("*").alias("n"))
    cut = each.groupBy("script", "size_class", "measure").agg(
        F.expr("percentile(cell, array(0.25D, 0.5D, 0.75D), n)").alias("q"), F.sum("n").alias("documents")
    ).where(F.col("documents") >= LEAST_DOCUMENTS)
    reach = REACH * F.greatest(F.col("q")[2] - F.col("q")[0], LEAST_RANGE * F.col("q")[1])
    bounds = F.struct(((F.col("q")[0] - reach) / GRID).alias("lo"), ((F.col("q")[2] + reach) / GRID).alias("hi"))
    return cut.groupBy("script", "size_class").agg(F.map_from_entries(F.collect_list(F.struct("measure", bounds))).alias("bands"))


def judged(rows: DataFrame, into: str, vocabularies: int, bands: dict[str, Band] | None) -> DataFrame:
    """Adds to the struct ``into`` what rejected the row (null for none) and ``kept``. ``rows`` is a written table."""
    fields, given = measure_fields(vocabularies), BANDS | (bands or {})
    script, none = F.col(f"{into}.script"), F.lit(None).cast("string")

    def fixed(pick: Callable[[Band], float]) -> Column:
        return reduce(lambda c, name: c.when(script == name, pick(given[name])), given, F.when(F.lit(False), 0.0)).otherwise(pick(given["other"]))

    plain = {
        "chars_per_token": (fixed(lambda b: b.min_chars), fixed(lambda b: b.max_chars)),
        "fallback_share": (F.lit(0.0), fixed(lambda b: b.max_fallback)),
        "token_entropy": (fixed(lambda b: b.min_entropy), fixed(lambda b: b.max_entropy)),
    }
    named = free_name(rows, "bands")
    limits = group_bands(rows, into, fields).where(~F.col("script").isin(list(bands or {}))).select(
        F.col("script").alias(f"{named}_s"), F.col("size_class").alias(f"{named}_c"), F.col("bands").alias(named)
    )
    verdict = F.when(F.col(f"{into}.base_failed"), "base")
    for m in fields:
        value, own, (lo, hi) = F.col(f"{into}.{m}"), F.col(named)[m], plain[re.sub(r"_\d$", "", m)]
        share = m.startswith("fallback")
        lo, hi = F.coalesce(F.lit(0.0) if share else own["lo"], lo), F.greatest(own["hi"], hi) if share else F.coalesce(own["hi"], hi)
        verdict = verdict.when(~value.between(lo, hi), m)
    out = rows.join(F.broadcast(limits), (script == F.col(f"{named}_s")) & (F.col(f"{into}.size_class") == F.col(f"{named}_c")), "left")
    rejected = verdict.otherwise(none)
    return out.select(
        *(F.col(c) for c in rows.columns if c != into),
        F.col(into).withField("rejected_by", rejected).withField("kept", rejected.isNull()).alias(into),
    )


def paths(vocabularies: list[str] | None) -> list[str]:
    return vocabularies or [public_tokenizers.path(VOCABULARY), public_tokenizers.path(SECOND)]


def apply_rules(docs: DataFrame, vocabularies: list[str] | None = None, bands: dict[str, Band] | None = None) -> DataFrame:
    """The counts, measures and verdict of each row of ``docs`` (doc_id, text).

    Words are runs of characters other than ASCII blanks. Null and empty texts have no words and fail. Repeated rows
    each get a row; a null doc_id stays null; other columns are not read. ``rejected_by`` is "base", the measure whose
    band rejects, or null. ``vocabularies`` are paths that every executor has (sentencepiece or tiktoken files);
    ``bands`` fixes those of the given scripts, which then have no bands by group.
    """
    files = paths(vocabularies)
    rows = written(measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), ["doc_id"], "rules", files), "fertility")
    out = judged(rows, "rules", len(files), bands)
    return out.select("doc_id", *(f"rules.{c}" for c in (*COUNTS, "base_failed", "kept", "rejected_by", "script", *measure_fields(len(files)))))


def keep_good(docs: DataFrame, vocabularies: list[str] | None = None, bands: dict[str, Band] | None = None) -> DataFrame:
    """The rows of ``docs`` that ``apply_rules`` keeps, with all their columns. Each row is judged on its own text."""
    files, into = paths(vocabularies), free_name(docs, "rules")
    rows = written(measured(docs, docs.columns, into, files), "fertility")
    return judged(rows, into, len(files), bands).where(f"`{into}`.kept").select(docs.columns)


def op1_fertility_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_rules(table(spark, sf_dir, "documents"))
