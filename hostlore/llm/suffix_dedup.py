"""Removal of long byte strings that a document with a smaller id has as well, by a run-length index.

Every 50-byte string has one *anchor*: the smallest hashed 16-byte string in it (the first, if several). Equal strings
have equal anchors, so strings that may repeat can be brought together without shipping all text:

1. Bloom filters of once-seen and twice-seen anchors find the anchors that two documents share (see ``seen_twice``); a fuller
   filter sends more fragments and changes nothing.
2. The strings with such an anchor lie in a *fragment* around it. A task settles fragments that repeat within it and
   sends one copy of the others to the bucket of the anchor. A passage in a third of all documents is one
   fragment a task, however many documents hold it. Fragments at its two edges differ, so those of a *hot* anchor (in
   ``HOT`` documents or more) are broken into their 50-byte strings, and each string goes to the bucket of its own hash.
3. A bucket settles equal fragments, sets aside those of whose strings none, by hash, occurs twice, and indexes the rest:
   the Burrows-Wheeler transform in runs, and where a run begins
   the position in the text, its neighbour (the suffix before it in order) and how far both match. Text and suffix order
   are then let go. Matching statistics are streamed along the text from these samples alone: one place on, the neighbour is
   one place on as well and the match one byte shorter. Neighbours that match over 50 bytes have the same string; the
   links to neighbours lead to the first of all that have it, and the smallest document among these keeps it.
4. Covered spans go back to their documents, in groups by document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlore.llm.common import byte_list, mix64, releasing, table, text_groups
from hostlore.llm.seen_twice import distinct, twice_seen

LENGTH = 50
ANCHOR = 16
#: Bytes of text for each anchor, about.
ANCHOR_BYTES = 17
#: A string's hash is that of its first and last so many bytes, which overlap.
HALF = 32
#: Suffixes are sorted by so many bytes, which is more than LENGTH.
DEPTH = 64
#: Text of a bucket, and of a group of documents in the last step.
GROUP_BYTES = 3 << 20
#: An anchor is hot from so many documents on, or where that would be over MOST_HOT anchors, from more on.
HOT = 1 << 14
MOST_HOT = 1 << 20
#: Strings of hot anchors are settled so many at once.
PIECES = 1 << 18


def hashed(data: np.ndarray, width: int) -> np.ndarray:
    """A hash of each string of ``width`` bytes, a power of two. Its low bits are not mixed."""
    h, now = data.astype(np.uint64) + np.uint64(1), 1
    while now < width:
        h = h[: h.size - now] * np.uint64(0x9E3779B97F4A7C15 + 2 * now) + (h[now:] ^ (h[now:] >> np.uint64(29)))
        now *= 2
    return h


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first, last): the anchor of the strings that start at first..last, for all strings of a text."""
    n = data.size - LENGTH + 1
    if n <= 0:
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64),) * 2)
    h = mix64(hashed(data, ANCHOR))
    low, span, reach = h, 1, LENGTH - ANCHOR + 1
    while span * 2 <= reach:
        low = np.minimum(low[: low.size - span], low[span:])
        span *= 2
    low = np.minimum(low[:n], low[reach - span : reach - span + n])
    # the place tells apart equal anchors of neighbouring strings
    at = np.flatnonzero(np.concatenate([[True], low[1:] != low[:-1]]))
    return low[at], at, np.concatenate([at[1:], [n]]) - 1


def own_anchors(text: bytes) -> np.ndarray:
    """The anchors of a text, each once."""
    return distinct(anchors(np.frombuffer(text, np.uint8))[0]) if len(text) >= LENGTH else np.empty(0, np.uint64)


ROUTED = "bucket int, body binary, meta binary"
META = np.dtype([("doc", "<i8"), ("row", "<i8"), ("at", "<i4"), ("size", "<i4"), ("anchor", "<u4")])
#: A row is known by its doc_id and a hash of it and its text.
SPAN = np.dtype([("doc", "<i8"), ("row", "<i8"), ("lo", "<i4"), ("hi", "<i4")])


def packed(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(1).compress(x if isinstance(x, bytes) else x.tobytes())


def unpacked(x: bytes, kind: np.dtype | None = None):
    raw = zstandard.ZstdDecompressor().decompress(x)
    return raw if kind is None else np.frombuffer(raw, kind)


def joined(spans: np.ndarray) -> np.ndarray:
    """Spans of a row that overlap or touch, as one."""
    if spans.size < 2:
        return spans
    spans = spans[np.lexsort((spans["lo"], spans["row"], spans["doc"]))]
    first = np.concatenate([[True], (spans["row"][1:] != spans["row"][:-1]) | (spans["doc"][1:] != spans["doc"][:-1])])
    # ends never fall within a row, once each row is lifted above the one before
    lift = np.cumsum(first).astype(np.int64) << 32
    reach = np.maximum.accumulate(spans["hi"] + lift)
    new = np.flatnonzero(first | np.concatenate([[True], spans["lo"][1:] + lift[1:] > reach[:-1]]))
    out = spans[new].copy()
    out["hi"] = (reach - lift)[np.concatenate([new[1:], [spans.size]]) - 1]
    return out


def span_rows(spans: np.ndarray, groups: int) -> list[tuple[int, bytes, bytes]]:
    """Rows of spans for each group of documents, with a negative bucket: -1 - group."""
    spans = joined(spans)
    group = spans["row"] % groups
    order = np.argsort(group, kind="stable")
    cut = np.flatnonzero(np.diff(group[order])) + 1
    return [(-1 - int(group[part[0]]), b"", packed(spans[part])) for part in np.split(order, cut) if part.size]


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [(), (), ()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "body", "meta"]
    )


def settle(bodies: list[bytes], meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which fragments an equal one of a smaller document covers; which others stand for their bytes in the index."""
    least: dict[bytes, int] = {}
    for body, doc in zip(bodies, meta["doc"].tolist(), strict=True):
        if doc < least.get(body, doc + 1):
            least[body] = doc
    first = np.fromiter((least[b] for b in bodies), np.int64, len(bodies))
    return meta["doc"] > first, meta["doc"] == first


def pieces(bodies: list[bytes], meta: np.ndarray) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """The 50-byte strings of fragments as fragments of their own; the hash of a string takes the place of its anchor."""
    n = meta["size"].astype(np.int64) - LENGTH + 1
    ends = np.cumsum(n)
    for lo in range(0, int(ends[-1]) if ends.size else 0, PIECES):
        place = np.arange(lo, min(lo + PIECES, int(ends[-1])))
        which = np.searchsorted(ends, place, "right")
        skip = place - (ends - n)[which]
        strings = [bodies[i][k : k + LENGTH] for i, k in zip(which.tolist(), skip.tolist(), strict=True)]
        part = meta[which]
        part["at"] += skip.astype(np.int32)
        part["size"] = LENGTH
        part["anchor"] = np.fromiter((xxhash.xxh3_64_intdigest(x) >> 32 for x in strings), np.uint32, len(strings))
        yield strings, part


def send_fragments(shared, buckets: int):
    """Fragments with a shared anchor to their buckets, and spans settled at once to their groups."""

    @releasing
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list[bytes], np.ndarray, np.ndarray]] = []
        twice = shared.value
        size = 0
        for part, texts in text_groups(batches, 2):
            for doc, row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts, strict=True):
                if len(text) < LENGTH:
                    continue
                h, first, last = anchors(np.frombuffer(text, np.uint8))
                on = twice.holds(h)
                if on.any():
                    h, first, stop = h[on], first[on], last[on] + LENGTH
                    meta = np.zeros(h.size, META)
                    meta["doc"], meta["row"], meta["at"], meta["size"] = doc, row, first, stop - first
                    meta["anchor"] = (h >> np.uint64(32)).astype(np.uint32)
                    held.append(([text[a:b] for a, b in zip(first.tolist(), stop.tolist(), strict=True)], meta, twice.among_often(h)))
                    size += int(meta["size"].sum())
            if size > 8 * GROUP_BYTES:
                yield from route(held)
                held, size = [], 0
        if held:
            yield from route(held)

    def route(held: list) -> Iterator[pa.RecordBatch]:
        bodies, meta, hot = [b for x, _, _ in held for b in x], np.concatenate([m for _, m, _ in held]), np.concatenate([x for _, _, x in held])
        covered, keeps = settle(bodies, meta)
        yield parcels(bodies, meta, covered, keeps & ~hot)
        broken = np.flatnonzero(keeps & hot)
        for strings, part in pieces([bodies[i] for i in broken], meta[broken]):
            yield parcels(strings, part, *settle(strings, part))

    def parcels(bodies: list[bytes], meta: np.ndarray, covered: np.ndarray, keeps: np.ndarray) -> pa.RecordBatch:
        out = span_rows(spans_of(meta[covered]), buckets)
        left = np.flatnonzero(keeps)
        bucket = meta["anchor"][left] % np.uint32(buckets)
        order = left[np.argsort(bucket, kind="stable")]
        cut = np.flatnonzero(np.diff(meta["anchor"][order] % np.uint32(buckets))) + 1
        for part in np.split(order, cut):
            if part.size:
                out.append((int(meta["anchor"][part[0]] % np.uint32(buckets)), packed(b"".join([bodies[i] for i in part])), packed(meta[part])))
        return as_batch(out)

    return send


def spans_of(meta: np.ndarray) -> np.ndarray:
    out = np.zeros(meta.size, SPAN)
    out["doc"], out["row"], out["lo"], out["hi"] = meta["doc"], meta["row"], meta["at"], meta["at"] + meta["size"]
    return out


def suffix_order(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their first DEPTH bytes, then of place; and the rank of each, ties alike."""
    n = text.size
    wide = np.concatenate([text, np.zeros(DEPTH, np.uint8)]).astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = key << np.uint64(8) | wide[k : k + n]
    width = 8
    while True:
        order = np.argsort(key, kind="stable" if width >= DEPTH else None)  # before, ties are alike or there are none
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if width >= DEPTH or rank[order[-1]] == n - 1:
            return order, rank
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key, width = rank * (n + 1) + second, width * 2


def common_bytes(text: np.ndarray, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Bytes in common from positions a and b, at most DEPTH and ``room``."""
    out, left, text = np.zeros(a.size, np.int64), np.arange(a.size), np.concatenate([text, np.zeros(DEPTH + 1, np.uint8)])
    for k in range(DEPTH):
        left = left[(text[a[left] + k] == text[b[left] + k]) & (room[left] > k)]
        if not left.size:
            break
        out[left] = k + 1
    return out


class RunLengthIndex:
    """The transform of fragments joined by 0xFF (which UTF-8 never has) in runs, with samples; neither text nor suffix order.

    ``symbols`` and ``lengths`` are the runs. A sample is a place ``at`` in the text, its neighbour ``near`` (the suffix
    before it in order) and their ``match``: at the beginning of each run and of each fragment, and where two
    suffixes can't be told apart by DEPTH bytes, as their order does not carry over to the places before.
    """

    def __init__(self, text: np.ndarray, room: np.ndarray):
        n = self.size = text.size
        order, rank = suffix_order(text)
        last = text[order - 1]
        heads = np.flatnonzero(np.concatenate([[True], last[1:] != last[:-1]]))
        self.symbols, self.lengths = last[heads], np.diff(np.append(heads, n))
        previous = np.empty(n, np.int64)  # the suffix before, along the text
        previous[order[1:]] = order[:-1]
        previous[order[0]] = -1
        place = np.arange(n)
        tied = (previous >= 0) & (rank == rank[previous])
        sampled = tied.copy()
        sampled[order[heads]] = sampled[0] = True
        sampled[np.flatnonzero(text == 0xFF)[:-1] + 1] = True
        sampled |= (previous > 0) & (place > 0) & (rank[place - 1] == rank[previous - 1])
        sampled[1:] |= tied[:-1]
        self.at = np.flatnonzero(sampled)
        self.near, alike = previous[self.at], tied[self.at]
        self.match = np.zeros(self.at.size, np.int64)
        one = np.flatnonzero(~alike & (self.near >= 0))
        self.match[one] = common_bytes(text, self.at[one], self.near[one], room[self.at[one]])
        self.match[alike] = np.minimum(DEPTH, room[self.at[alike]])

    def matching_statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each place of the text: its neighbour, and the bytes they have in common."""
        gaps = np.diff(np.append(self.at, self.size))
        skip = np.arange(self.size) - np.repeat(self.at, gaps)
        return np.repeat(self.near, gaps) + skip, np.maximum(np.repeat(self.match, gaps) - skip, 0)


def covered_strings(bodies: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each fragment, which of its 50-byte strings another fragment of a smaller document has."""
    sizes = np.array([len(b) for b in bodies])
    ends = np.cumsum(sizes + 1) - 1
    n = int(ends[-1]) + 1
    owner = np.repeat(np.arange(sizes.size), sizes + 1)
    room = ends[owner] - np.arange(n)
    near, match = RunLengthIndex(np.frombuffer(b"\xff".join([*bodies, b""]), np.uint8), room).matching_statistics()
    # links to neighbours lead to the first suffix with the same string
    first = np.where(match >= LENGTH, near, np.arange(n))
    while (further := first[first]).tobytes() != first.tobytes():
        first = further
    doc = docs[owner]
    least = doc.copy()
    linked = np.flatnonzero(match >= LENGTH)
    np.minimum.at(least, first[linked], doc[linked])
    covered = (least[first] < doc) & (room >= LENGTH)
    return [covered[e - s : max(e - s, e - LENGTH + 1)] for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]


def have_repeats(bodies: list[bytes]) -> np.ndarray:
    """Which fragments have a 50-byte string whose hash occurs twice in all of them."""
    data, sizes = np.frombuffer(b"".join(bodies), np.uint8), np.fromiter(map(len, bodies), np.int64, len(bodies))
    half, total, n = hashed(data, HALF), data.size - LENGTH + 1, sizes - LENGTH + 1
    place = np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    h = mix64(half[:total] * np.uint64(0xD1342543DE82EF95) + mix64(half[LENGTH - HALF : LENGTH - HALF + total]))[place]
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    twin = np.zeros(h.size, bool)
    twin[order[1:][same]] = twin[order[:-1][same]] = True
    return np.bincount(np.repeat(np.arange(sizes.size), n), twin, sizes.size) > 0


def settle_bucket(groups: int):
    def settle_rows(table_: pa.Table) -> pa.Table:
        """The spans of a bucket's fragments, as rows for the groups of their documents; such rows pass."""
        rows = table_.to_pylist()
        if rows[0]["bucket"] < 0:
            return table_
        meta = np.concatenate([unpacked(r["meta"], META) for r in rows])
        bodies: list[bytes] = []
        for r in rows:
            body, at = unpacked(r["body"]), 0
            for size in unpacked(r["meta"], META)["size"].tolist():
                bodies.append(body[at : at + size])
                at += size
        covered, keeps = settle(bodies, meta)
        found = [spans_of(meta[covered])]
        # anchors with one fragment left have nothing to compare; equal ones of one document stand once
        once: dict[bytes, list[int]] = {}
        for i in np.flatnonzero(keeps).tolist():
            once.setdefault(bodies[i], []).append(i)
        firsts = np.array([v[0] for v in once.values()], np.int64)
        _, which, count = np.unique(meta["anchor"][firsts], return_inverse=True, return_counts=True) if firsts.size else (None, firsts, firsts)
        several = firsts[count[which] > 1] if firsts.size else firsts
        if several.size:
            several = several[have_repeats([bodies[i] for i in several])]
        if several.size:
            for i, mask in zip(several.tolist(), covered_strings([bodies[i] for i in several], meta["doc"][several]), strict=True):
                if mask.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                    for j in once[bodies[i]]:
                        part = np.zeros(edge.size // 2, SPAN)
                        part[
                            "doc"
                        ], part[
                            "row"
                        ], part["lo"], part["hi"] = meta["doc"][j], meta["row"][j], meta["at"][j] + edge[::2], meta["at"][j] + edge[1::2] - 1 + LENGTH
                        found.append(part)
        return pa.Table.from_batches([as_batch(span_rows(np.concatenate(found), groups))])

    return settle_rows


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def cut_group(docs: pa.Table, spans: pa.Table) -> pa.Table:
    """Cuts the spans out of the documents of one group."""
    own = np.concatenate([unpacked(x, SPAN) for x in spans.column("meta").to_pylist()] or [np.empty(0, SPAN)])
    own = own[np.lexsort((own["lo"], own["row"], own["doc"]))]
    out = []
    new = np.flatnonzero(
        np.concatenate([[True], (own["row"][1:] != own["row"][:-1]) | (own["doc"][1:] != own["doc"][:-1])])
    ) if own.size else np.empty(0, np.int64)
    ranges = dict(
        zip(
            zip(own["doc"][new].tolist(), own["row"][new].tolist(), strict=True),
            zip(new.tolist(), np.append(new[1:], own.size)[: new.size].tolist(), strict=True),
            strict=True,
        )
    )
    for doc_id, row, text in zip(docs.column("doc_id").to_pylist(), docs.column("row").to_pylist(), byte_list(docs.column("text")), strict=True):
        text = text or b""
        a, b = ranges.get((doc_id, row), (0, 0))
        at, kept, removed, n_spans, open_to = 0, [], 0, 0, -1
        for s, e in zip(own["lo"][a:b].tolist(), own["hi"][a:b].tolist(), strict=True):
            if s > open_to:
                kept.append(text[at:s])
                n_spans += 1
            removed += max(0, e - max(s, open_to))
            open_to = at = max(open_to, e)
        kept.append(text[at:])
        out.append((doc_id, len(text), removed, n_spans, b"".join(kept)))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.Table.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else ((),) * 5, kinds, strict=True)],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
    )


def dedup_strings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) for each row of ``docs`` (doc_id, text).

    A byte goes if a 50-byte string over it also starts in a row with a smaller doc_id; strings are judged on the
    input. Null texts are empty. Rows that repeat a doc_id don't cover each other; rows with a null doc_id neither
    cover nor lose anything. Other columns are not read.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(16, int(size // GROUP_BYTES))
    keyed = plain.withColumn("row", F.xxhash64("doc_id", "text")).withColumn("group", F.pmod("row", F.lit(groups)).cast("int"))
    usable = keyed.where("doc_id is not null")
    expected = size // ANCHOR_BYTES
    shared = spark.sparkContext.broadcast(twice_seen(usable, own_anchors, expected, max(HOT, expected // MOST_HOT)))
    routed = usable.select("doc_id", "row", "text").mapInArrow(send_fragments(shared, groups), ROUTED)
    settled = routed.groupBy("bucket").applyInArrow(settle_bucket(groups), ROUTED)
    spans = settled.select((-1 - F.col("bucket")).alias("group"), "meta")
    return keyed.groupBy("group").cogroup(spans.groupBy("group")).applyInArrow(cut_group, KEPT)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_strings(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
