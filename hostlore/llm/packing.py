"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

Lengths fall into classes by reciprocals of the capacity: class k has pieces of capacity // k tokens, and one of its
sequences takes exactly k of them. A document gives off full sequences, then the largest class size that its rest
still holds, and so on; each step leaves less than 1 / (k (k + 1)) of the capacity. Only classes that waste at most
``SLACK`` tokens a sequence are used. Rests under ``GRAIN`` tokens, and what is in unfinished sequences at the end, go
into sequences one after another, cut where one is full; the last is cut into powers of two, which need no padding.

Every worker packs its own partition with the same rule, so nothing is shuffled and only one unfinished sequence a
class is held.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlore.llm.common import releasing, table, text_groups
from hostlore.llm.transducer import compiled

VOCABULARY = "word_bpe_49k.json"
CAPACITY = 4096
END_ID = 2
GRAIN = 64
SLACK = 4
FIELDS = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def class_sizes(capacity: int) -> list[tuple[int, int]]:
    """(pieces of a sequence, tokens of a piece), longest first."""
    return [(k, capacity // k) for k in range(1, capacity // GRAIN + 1) if capacity % k <= SLACK]


class Packer:
    """Packs one partition; ``rows`` gathers finished pieces."""

    def __init__(self, capacity: int, partition: int):
        self.capacity, self.classes = capacity, class_sizes(capacity)
        self.next = partition << 40
        self.open: dict[int, list[tuple]] = {}
        self.grains: list[tuple] = []
        self.grain_tokens = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, ids.size, zlib.crc32(ids.astype("<u4").tobytes()), total, self.next, offset))
            offset += ids.size
        self.next += 1

    def grain(self, piece: tuple) -> None:
        """Adds a piece to the running sequence, cut where that is full."""
        doc_id, start, ids, total = piece
        while self.grain_tokens + ids.size >= self.capacity:
            room = self.capacity - self.grain_tokens
            self.close([*self.grains, (doc_id, start, ids[:room], total)])
            self.grains, self.grain_tokens = [], 0
            start, ids = start + room, ids[room:]
        if ids.size:
            self.grains.append((doc_id, start, ids, total))
            self.grain_tokens += ids.size

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at, total = 0, ids.size
        for k, size in self.classes:
            while total - at >= size:
                bin_ = self.open.setdefault(k, [])
                bin_.append((doc_id, at, ids[at : at + size], total))
                at += size
                if len(bin_) == k:
                    self.close(self.open.pop(k))
        if at < total:
            self.grain((doc_id, at, ids[at:], total))

    def finish(self) -> None:
        for _, pieces in sorted(self.open.items()):
            for piece in pieces:
                self.grain(piece)
        self.open = {}
        rest, self.grains = self.grains, []
        while self.grain_tokens:
            size, taken = 1 << self.grain_tokens.bit_length() - 1, []
            self.grain_tokens -= size
            while size:
                doc_id, start, ids, total = rest.pop(0)
                taken.append((doc_id, start, ids[:size], total))
                if ids.size > size:
                    rest.insert(0, (doc_id, start + size, ids[size:], total))
                size -= taken[-1][2].size
            self.close(taken)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row for each piece of each document of ``docs`` (doc_id, text).

    A document is its token ids, then ``end_id``; null and empty texts are that one id. Pieces tell their place in the
    document (start, length, doc_tokens), the CRC of their ids, and their place in a sequence (sequence_id, offset).
    Repeated rows are packed each on their own; a null doc_id stays null; other columns are not read.
    """

    @releasing
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(vocabulary or public_tokenizers.path(VOCABULARY))
        packer = Packer(capacity, TaskContext.get().partitionId())

        def flush() -> pa.RecordBatch:
            columns, packer.rows = list(zip(*packer.rows, strict=True)), []
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(FIELDS))

        for part, texts in text_groups(batches, 1):
            for doc_id, own in zip(part.column(0).to_pylist(), machine.ids([t.decode() for t in texts]), strict=True):
                packer.add(doc_id, np.append(own, np.uint32(end_id)))
            if packer.rows:
                yield flush()
        packer.finish()
        if packer.rows:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, ", ".join(f"`{x}` long" for x in FIELDS))


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
