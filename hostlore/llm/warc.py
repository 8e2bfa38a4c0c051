"""WARC archives in seekable Zstandard bundles.

A bundle is one file: frames that each hold a group of whole records and decode on their own; a skippable frame that
maps record identifiers to (frame, offset in the decoded frame, length); and the seek table, a skippable frame at
the very end with the sizes and checksum of every frame. A record is read by seeking to its one frame.

Bundles are files of the shared folder or any path Spark can write. Spark's text writer puts one row in each file and ends
it with the "line separator"; as the last three bytes of a seek table are the UTF-8 form of U+A48F, that character is
the separator, and the file is the bundle byte for byte.

Of records with the same payload, that with the smallest page_id is a response and the others are revisits, which refer
to it and carry no payload.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlore.llm.common import byte_list, join_weighted, shared_path, table, utf8, written

#: Fixed values of the seekable format: magic numbers, and the flag for checksums.
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20
MOST_PATHS = 10_000
MIN_REVISIT_BYTES = 100
END = "꒏"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record; a revisit has no payload but tells its digest and length."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Payload-Length: {len(payload)}"]
    block = HTTP + payload if refers_to is None else HTTP
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The header fields and the payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def page_of(urn: str | None) -> int | None:
    number = (urn or "")[len("<urn:page:") : -1]
    return int(number) if number else None


class Bundle:
    """Gathers records and gives the bytes of the bundle."""

    def __init__(self, frame_bytes: int):
        self.frame_bytes = frame_bytes
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[bytes] = []
        self.seek: list[tuple[int, int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.open: list[bytes] = []
        self.open_bytes = self.total = 0

    def add(self, record_id: str, raw: bytes) -> None:
        self.index.append((record_id, len(self.seek), self.open_bytes, len(raw)))
        self.open.append(raw)
        self.open_bytes += len(raw)
        self.total += len(raw)
        if self.open_bytes >= self.frame_bytes:
            self.close_frame()

    def close_frame(self) -> None:
        if self.open:
            raw = b"".join(self.open)
            self.frames.append(self.compressor.compress(raw))
            self.seek.append((len(self.frames[-1]), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.open, self.open_bytes = [], 0

    def finish(self) -> bytes:
        self.close_frame()
        ids = self.compressor.compress(json.dumps([list(c) for c in zip(*self.index, strict=True)]).encode())
        self.frames.append(struct.pack("<II", INDEX_MAGIC, len(ids)) + ids)
        self.seek.append((len(self.frames[-1]), 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF))
        entries = b"".join(struct.pack("<III", *s) for s in self.seek)
        footer = struct.pack("<IBI", len(self.seek), CHECKSUMS, FOOTER_MAGIC)
        return b"".join([*self.frames, struct.pack("<II", SEEK_MAGIC, len(entries) + len(footer)), entries, footer])


class Reader:
    """Random access to a bundle's bytes."""

    def __init__(self, data: bytes):
        n, flags, magic = struct.unpack("<IBI", data[-9:])
        if magic != FOOTER_MAGIC or flags != CHECKSUMS:
            raise ValueError("no seek table")
        table_at = len(data) - 9 - 12 * n
        self.data, self.seek, at = data, [], 0
        for size, decoded, check in struct.iter_unpack("<III", data[table_at : len(data) - 9]):
            self.seek.append((at, size, decoded, check))
            at += size
        if at != table_at - 8:
            raise ValueError("the seek table does not fit the file")
        at, size, _, _ = self.seek[-1]
        self.decompressor = zstandard.ZstdDecompressor()
        self.index = list(zip(*json.loads(self.decompressor.decompress(data[at + 8 : at + size])), strict=True))
        self.held: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self.held[0] != k:
            at, size, decoded, check = self.seek[k]
            raw = self.decompressor.decompress(self.data[at : at + size])
            if len(raw) != decoded or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                raise ValueError(f"frame {k} is damaged")
            self.held = k, raw
        return self.held[1]

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def with_decisions(pages: DataFrame) -> DataFrame:
    """Adds the payload, its digest, and ``refers_to`` (null for responses)."""
    keyed = pages.select("page_id", "url", utf8("html").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = keyed.where((F.octet_length("payload") >= MIN_REVISIT_BYTES) & F.col("page_id").isNotNull()).select("page_id", "digest")
    groups = written(large.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1"), "payload-groups")
    revisits = join_weighted(large, groups, "digest", "n").where("page_id > refers_to").dropDuplicates(["page_id", "digest"])
    return keyed.join(revisits, ["page_id", "digest"], "left")


def write_archives(pages: DataFrame, path: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html) into bundles under ``path``.

    The payload is the html in UTF-8, empty for null. Payloads under MIN_REVISIT_BYTES and rows with a null page_id
    are always responses; rows that repeat page_id and payload get equal records. Other columns are not read. No key
    decides where a record goes, so equal payloads do not meet in one task.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = Bundle(frame_bytes)
        for batch in batches:
            for page_id, digest, url, payload, refers_to in zip(
                batch.column(0).to_pylist(),
                batch.column(1).to_pylist(),
                batch.column(2).to_pylist(),
                byte_list(batch.column(3)),
                batch.column(4).to_pylist(),
                strict=True,
            ):
                bundle.add(f"<urn:page:{'' if page_id is None else page_id}>", record(page_id, url, payload, digest, refers_to, date))
                if bundle.total >= bundle_bytes:
                    yield packed(bundle)
                    bundle = Bundle(frame_bytes)
        if bundle.total:
            yield packed(bundle)

    def packed(bundle: Bundle) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bundle.finish()[: -len(END.encode())]], pa.binary())], names=["bundle"])

    rows = with_decisions(pages).select(
        F.col("page_id").cast("long").alias("page_id"),
        "digest",
        F.col("url").cast("string").alias("url"),
        "payload",
        F.col("refers_to").cast("long").alias("refers_to"),
    )
    rows.mapInArrow(write, "bundle binary").select(
        F.col("bundle").cast("string").alias("value")
    ).write.option("lineSep", END).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the bundles under ``path``; digest and length of a response are those of its payload as read."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), byte_list(batch.column(1)), strict=True):
                rows, bundle = [], Reader(data)
                for _, frame, offset, length in bundle.index:
                    fields, payload = parsed(bundle.record(frame, offset, length))
                    digest, size = fields["WARC-Payload-Digest"].removeprefix("sha256:"), len(payload)
                    if fields["WARC-Type"] == "revisit":
                        size = int(fields["WARC-Payload-Length"])
                    elif hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"{fields['WARC-Record-ID']}: payload and digest differ")
                    rows.append(
                        (
                            page_of(fields["WARC-Record-ID"]),
                            size,
                            digest,
                            fields["WARC-Type"],
                            page_of(fields.get("WARC-Refers-To")),
                            name,
                            frame,
                            offset,
                            length,
                        )
                    )
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=[f"c{i}" for i in range(9)])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame " "long, frame_offset long, record_bytes long"
    return bundles(spark, path).mapInArrow(read, schema)


def bundles(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def fetch_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(page_id, payload) of the responses that ``wanted`` (page_id, bundle, frame, frame_offset, record_bytes) names.

    Only the frames that hold them are decoded, and only the bundles named are read (Spark's reader takes a bundle as a
    whole): by their paths, or where there are over MOST_PATHS, by a join with all bundles.
    """
    spots = wanted.groupBy(F.col("bundle").alias("path")).agg(F.sort_array(F.collect_list(F.struct("frame", "frame_offset", "record_bytes"))).alias("spots"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, own in zip(byte_list(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                bundle = Reader(data)
                found = [parsed(bundle.record(s["frame"], s["frame_offset"], s["record_bytes"])) for s in own]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([page_of(f["WARC-Record-ID"]) for f, _ in found], pa.int64()), pa.array([p for _, p in found], pa.binary())],
                    names=["page_id", "payload"],
                )

    spots = written(spots, "record-spots")
    paths = [r.path for r in spots.select("path").limit(MOST_PATHS + 1).collect()]
    if not paths:
        return spark.createDataFrame([], "page_id long, payload binary")
    return bundles(spark, path if len(paths) > MOST_PATHS else paths).join(spots, "path").select("content", "spots").mapInArrow(
        fetch, "page_id long, payload binary"
    )


def op2_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "archives")
    write_archives(table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n, sha256(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, min(page_id) AS f FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN g.f < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.f < page_id THEN g.f END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n >= 100
"""
