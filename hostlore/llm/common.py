"""What several corpus operators share: the shared folder, written intermediate tables, and a join that survives hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlore.sources.tables import shared_path

#: A key is hot when it holds this share of the rows or more, or so many rows; MOST_HOT bounds the number of hot keys.
HOT_SHARE = 0.001
HOT_ROWS = 1 << 20
MOST_HOT = 1 << 18


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts lineage, and survives a lost executor."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores before it, so that ``df`` has no such column (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def release() -> None:
    """At a task's end: gives memory that the worker process no longer needs back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def releasing(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``work`` on a task's batches; what it held is let go when it has ended, and only then is memory given back."""

    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        release()

    return run


def byte_list(column: pa.Array) -> list:
    """A string or binary Arrow column as bytes objects, None for null."""
    return column.cast(pa.binary()).to_pylist()


def utf8(column: Column | str) -> Column:
    """UTF-8 bytes of a string column; null counts as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).cast("binary")


def join_weighted(left: DataFrame, right: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has one row per ``key`` and in ``weight`` its number of left rows.

    Keys with HOT_SHARE of all matching rows or HOT_ROWS rows, at most MOST_HOT in number, are hot: their rows of
    ``right`` are broadcast. The rest meets by an ordinary shuffle, in which a key has fewer rows than that (or, where
    there are over MOST_HOT * HOT_ROWS rows in all, than one in MOST_HOT). ``right`` should be a written table, as it is
    read three times.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    bound = max(2, int(min(total * HOT_SHARE, max(HOT_ROWS, total / MOST_HOT))))
    hot = right.where(F.col(weight) >= bound).drop(weight)
    cold = right.where(F.col(weight) < bound).drop(weight)
    return left.join(F.broadcast(hot), key).unionByName(left.join(cold, key))


MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= MIX_A
    x ^= x >> np.uint64(27)
    x *= MIX_B
    x ^= x >> np.uint64(31)
    return x


def text_groups(batches: Iterator[pa.RecordBatch], column: int, size: int = 8 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with about ``size`` bytes of text, and their texts (empty for null). Only one slice is held as bytes objects."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        lo = held = 0
        for i, n in enumerate(sizes):
            held += n
            if held >= size or i == len(sizes) - 1:
                part = batch.slice(lo, i + 1 - lo)
                yield part, [t or b"" for t in byte_list(part.column(column))]
                lo, held = i + 1, 0


def terms_table(*kept: range) -> bytes:
    """A table for ``bytes.translate``: A-Z in lower case, all ASCII outside the ranges ``kept`` a blank, other bytes as they are."""
    keep = {b for r in kept for b in r} | set(range(128, 256))
    return bytes((b + 32 if 65 <= b <= 90 else b) if b in keep else 32 for b in range(256))


def term_lists(text: bytes, table: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of about ``size`` bytes, so that a very long text isn't held as words at once."""
    lo = 0
    while lo < len(text):
        hi, step = lo + size, text[lo : lo + size].translate(table)
        while hi < len(text) and step[-1:] != b" ":  # to the end of the term that the cut is in
            more = text[hi : hi + 4096].translate(table)
            cut = more.find(b" ") + 1 or len(more)
            step, hi = step + more[:cut], hi + cut
        yield step.split()
        lo = hi


BLOCKS = 16


def to_blocks(total: np.ndarray) -> pa.RecordBatch:
    """A table of whole numbers as rows (block, sums), packed."""
    width = -(-total.size // BLOCKS)
    padded = np.zeros(width * BLOCKS, np.int64)
    padded[: total.size] = total
    return packed_blocks(list(padded.reshape(BLOCKS, width)), list(range(BLOCKS)))


def packed_blocks(rows: list[np.ndarray], numbers: list[int]) -> pa.RecordBatch:
    pack = zstandard.ZstdCompressor(3).compress
    small = [r.astype(np.int32) if abs(r).max(initial=0) < 2**31 else r for r in rows]
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array([pack(r.tobytes()) for r in small], pa.binary())], names=["block", "sums"])


def block_sums(rows: DataFrame, cells: int) -> np.ndarray:
    """The sum of all tables that ``to_blocks`` made, on the driver: blocks are added up as they stream by."""
    width = -(-cells // BLOCKS)

    def unpacked(data: bytes) -> np.ndarray:
        raw = zstandard.ZstdDecompressor().decompress(data)
        return np.frombuffer(raw, np.int32 if len(raw) == 4 * width else np.int64).astype(np.int64)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = unpacked(data)
                merged[block] = merged[block] + part if block in merged else part
        if merged:
            yield packed_blocks(list(merged.values()), list(merged))

    out = np.zeros((BLOCKS, width), np.int64)
    for block, data in rows.repartition(BLOCKS, "block").mapInArrow(merge, "block int, sums binary").collect():
        out[block] = unpacked(data)
    return out.ravel()[:cells]


def corpus_sum(rows: DataFrame, cells: int, add: Callable[..., None], columns: Iterable[str] = ("text",)) -> np.ndarray:
    """A table of ``cells`` whole numbers summed over all texts of ``rows``, on the driver.

    ``add`` adds a list of texts (the first of ``columns``) to a task's own table, with the other columns. The tables meet
    block by block, so no task holds more than one table and the driver holds one, whatever the corpus.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part, texts in text_groups(batches, 0):
            total = np.zeros(cells, np.int64) if total is None else total
            add(total, texts, *part.columns[1:])
        if total is not None:
            yield to_blocks(total)
        release()

    return block_sums(rows.select(*columns).mapInArrow(fill, "block int, sums binary"), cells)
