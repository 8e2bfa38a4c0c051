"""Which hashes occur in two documents or more, by two Bloom filters that hold at any size of the corpus.

1. Tasks send the distinct hashes of about ``GROUP_BYTES`` of text, with the number of documents that have each, to the
   segment of the hash. A hash in a third of all documents is one entry for each such group.
2. A segment has a filter of *once-seen* hashes. A hash that it holds already, or that two documents of a group have, is
   seen twice. There is a segment for each SEGMENT_HASHES expected, so its filter is about as full for any corpus.
3. The hashes seen twice make the second filter, a slice for each segment, with ``BITS_EACH`` bits for each hash and
   ``MAX_BITS`` at most in all. This one is broadcast; it holds what repeats, not all that there is.

Both filters only err by holding too much: callers confirm what they find, and a fuller filter changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlore.llm.common import byte_list, mix64, releasing, text_groups, written

GROUP_BYTES = 32 << 20
SEGMENT_HASHES = 1 << 25
LEAST_SEGMENTS = 16
#: Bits of a once-seen filter for each hash expected in its segment.
BITS_EACH = 12
HASHES = 3
MAX_BITS = 1 << 29
#: Hashes that fewer documents of a group have are not counted towards the often-seen ones.
LEAST = 4
OFTEN = np.dtype([("hash", "<u8"), ("n", "<i8")])


def packed(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(1).compress(x.tobytes())


def unpacked(x: bytes, kind: str | np.dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each hash, one row for each hash function (double hashing). ``bits`` is a power of two."""
    h = mix64(hashes)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(HASHES)]).astype(np.int64)


def has_all(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=0)


def put(bitmap: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(bitmap, at >> 3, np.left_shift(np.uint8(1), (at & 7).astype(np.uint8)))


def power(n: float) -> int:
    """The power of two from ``n`` on, 64 at least."""
    return 1 << max(6, int(n - 1).bit_length() if n > 1 else 0)


def distinct(hashes: np.ndarray) -> np.ndarray:
    """Sorted, each once."""
    ranked = np.sort(hashes)
    return ranked[np.append(True, ranked[1:] != ranked[:-1])] if ranked.size else ranked


class TwiceSeen:
    """The second filter, and the hashes that many documents have, sorted."""

    def __init__(self, slices: np.ndarray, often: np.ndarray):
        self.segments, self.bits = len(slices), slices.shape[1] * 8
        self.bitmap, self.often = slices.ravel(), often

    def among_often(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.often, hashes), max(0, self.often.size - 1))
        return self.often[at] == hashes if self.often.size else np.zeros(hashes.size, bool)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        if not hashes.size:
            return np.zeros(0, bool)
        first = (hashes % np.uint64(self.segments)).astype(np.int64) * self.bits
        return has_all(self.bitmap, places(hashes, self.bits) + first)


def summed(parts: list[np.ndarray]) -> np.ndarray:
    """One row for each hash, with the sum of its counts."""
    rows = np.concatenate(parts)
    each, which = np.unique(rows["hash"], return_inverse=True)
    out = np.zeros(each.size, OFTEN)
    out["hash"] = each
    np.add.at(out["n"], which, rows["n"])
    return out


def send_hashes(hashes_of: Callable[[bytes], np.ndarray], segments: int, group_bytes: int):
    """Rows (segment, hashes, counts) of groups of texts. ``hashes_of`` gives the hashes of a text, each once."""

    @releasing
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for _, texts in text_groups(batches, 0):
            for text in texts:
                if (own := hashes_of(text)).size:
                    held.append(own)
                size += len(text)
            if size >= group_bytes and held:
                yield rows(held)
                held, size = [], 0
        if held:
            yield rows(held)

    def rows(held: list[np.ndarray]) -> pa.RecordBatch:
        each, count = np.unique(np.concatenate(held), return_counts=True)
        segment = (each % np.uint64(segments)).astype(np.int64)
        order = np.argsort(segment, kind="stable")
        parts = np.split(order, np.flatnonzero(np.diff(segment[order])) + 1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([int(segment[p[0]]) for p in parts], pa.int32()),
                pa.array([packed(each[p]) for p in parts], pa.binary()),
                pa.array([packed(count[p].astype("<u4")) for p in parts], pa.binary()),
            ],
            names=["segment", "hashes", "counts"],
        )

    return send


def look_twice(bits: int, often: int):
    """Rows (segment, n, twice, often) of rows sorted by segment."""

    @releasing
    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, once, found, many = None, np.zeros(0, np.uint8), [], []
        for batch in batches:
            for segment, hashes, counts in zip(batch.column(0).to_pylist(), byte_list(batch.column(1)), byte_list(batch.column(2)), strict=True):
                if segment != now:
                    if now is not None:
                        yield ended(now, found, many)
                    now, once, found, many = segment, np.zeros(bits // 8, np.uint8), [], []
                h, n = unpacked(hashes, "<u8"), unpacked(counts, "<u4")
                at = places(h, bits)
                found.append(h[has_all(once, at) | (n > 1)])
                put(once, at)
                if (n >= LEAST).any():
                    part = np.zeros(int((n >= LEAST).sum()), OFTEN)
                    part["hash"], part["n"] = h[n >= LEAST], n[n >= LEAST]
                    many.append(part)
                if len(found) > 64:
                    found = [distinct(np.concatenate(found))]
                    many = [summed(many)] if many else []
        if now is not None:
            yield ended(now, found, many)

    def ended(segment: int, found: list[np.ndarray], many: list[np.ndarray]) -> pa.RecordBatch:
        twice, counts = distinct(np.concatenate(found)), summed([np.zeros(0, OFTEN), *many])
        frequent = counts["hash"][counts["n"] >= often]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([segment], pa.int32()),
                pa.array([twice.size], pa.int64()),
                pa.array([packed(twice)], pa.binary()),
                pa.array([packed(frequent)], pa.binary()),
            ],
            names=["segment", "n", "twice", "often"],
        )

    return look


def twice_seen(docs: DataFrame, hashes_of: Callable[[bytes], np.ndarray], expected: int, often: int = 1 << 62) -> TwiceSeen:
    """The filter of hashes that two rows of ``docs`` (text) or more have, and which ``often`` or more have.

    ``expected``: about how many hashes there are in all rows together. ``often`` should grow with it, as the driver
    holds these hashes.
    """
    segments = max(LEAST_SEGMENTS, -(-expected // SEGMENT_HASHES))
    bits = power(BITS_EACH * expected / segments)
    sent = docs.select("text").mapInArrow(send_hashes(hashes_of, segments, GROUP_BYTES), "segment int, hashes binary, counts binary")
    looked = sent.repartition(segments, "segment").sortWithinPartitions("segment").mapInArrow(
        look_twice(bits, often), "segment int, n long, twice binary, often binary"
    )
    looked = written(looked, "twice-seen")
    most = looked.agg(F.max("n")).first()[0] or 0
    width = max(64, min(power(BITS_EACH * most), power(MAX_BITS // segments + 1) // 2))

    @releasing
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for segment, twice, frequent in zip(batch.column(0).to_pylist(), byte_list(batch.column(1)), byte_list(batch.column(2)), strict=True):
                bitmap = np.zeros(width // 8, np.uint8)
                put(bitmap, places(unpacked(twice, "<u8"), width))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([segment], pa.int32()), pa.array([packed(bitmap)], pa.binary()), pa.array([frequent], pa.binary())],
                    names=["segment", "bitmap", "often"],
                )

    out, many = np.zeros((segments, width // 8), np.uint8), [np.zeros(0, "<u8")]
    for segment, bitmap, frequent in looked.select("segment", "twice", "often").mapInArrow(slices, "segment int, bitmap binary, often binary").collect():
        out[segment] = unpacked(bitmap, np.uint8)
        many.append(unpacked(frequent, "<u8"))
    return TwiceSeen(out, np.sort(np.concatenate(many)))
