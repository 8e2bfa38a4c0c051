"""Corpus-wide removal of repeated lines, with two Bloom filters in front of the exact count.

1. The 64-bit hashes of line keys go to a segment of their own, which tells by a filter of once-seen hashes which of them two
   documents have; those make the filter of twice-seen hashes (see ``seen_twice``).
2. Lines whose key is in the *twice* filter are the suspects. Only they are shuffled, with their full key:
   the exact number of documents per key and the document that keeps its lines come from there.
3. Documents that lose lines are rebuilt. The keys in enough documents and who keeps them are few, as a rule; where they
   take at most ``BROADCAST_BYTES``, they are broadcast and no text is shuffled. Beyond that, each document's lost keys
   are gathered and joined to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.types import StructType

from hostlore.llm.common import free_name, join_weighted, releasing, table, text_groups, utf8, written
from hostlore.llm.seen_twice import twice_seen

BLANKS = " \t\n\x0b\x0c\r"
MIN_CHARS = 40
MIN_DOCS = 5
#: Repeated keys are broadcast up to this size.
BROADCAST_BYTES = 16 << 20


def line_keys(text: bytes | None, min_chars: int) -> set[bytes]:
    """The distinct keys of at least ``min_chars`` code points of a text's lines."""
    if not text or len(text) < min_chars:
        return set()
    keys = set()
    for line in text.split(b"\n"):
        if len(line) >= min_chars:
            key = line.strip(b" \t\n\x0b\x0c\r")
            if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                keys.add(key.lower())
    return keys


def key_hashes(keys: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def suspect_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, key) of the lines that the twice filter holds."""
    expected = text_bytes(docs) // (2 * max(1, min_chars))
    shared = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, lambda text: key_hashes(list(line_keys(text, min_chars))), expected))

    @releasing
    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = shared.value
        for part, texts in text_groups(batches, 1):
            ids, found = [], []
            for doc_id, text in zip(part.column(0).to_pylist(), texts, strict=True):
                if keys := list(line_keys(text, min_chars)):
                    hit = twice.holds(key_hashes(keys))
                    found += (own := [k for k, h in zip(keys, hit, strict=True) if h])
                    ids += [doc_id] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary()).cast(pa.string())], names=["doc_id", "key"])

    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text").mapInArrow(probe, "doc_id long, key string")


def repeated_lines(suspects: DataFrame, min_docs: int) -> DataFrame:
    """(key, keeper, n): keys in enough documents, the largest doc_id, and the number of rows. A written table."""
    counted = suspects.groupBy("key").agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("keeper"), F.count("*").alias("n"))
    return written(counted.where(F.col("n_docs") >= min_docs).select("key", "keeper", "n"), "line-repeats")


def lost_lines(suspects: DataFrame, repeated: DataFrame) -> DataFrame:
    """(doc_id, keys): the line keys that each document loses; documents that lose none have no row."""
    return join_weighted(suspects, repeated, "key", "n").where("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set("key").alias("keys"))


LINES = "kept_text: string, n_lines: long, n_dropped: long"


def cut_lines(docs: DataFrame, into: str, keepers: dict[bytes, int], min_chars: int) -> DataFrame:
    """``docs`` and a struct ``into``, by a broadcast of the repeated keys and who keeps them."""
    shared = docs.sparkSession.sparkContext.broadcast(keepers)
    own, names, text = free_name(docs, "own_id"), [*docs.columns, into], docs.columns.index("text")

    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeper = shared.value.get
        for part, texts in text_groups(batches, text):
            kept, n_lines, n_dropped = [], [], []
            for doc_id, body in zip(part.column(part.num_columns - 1).to_pylist(), texts, strict=True):
                left = lines = body.split(b"\n")
                if doc_id is not None and len(body) >= min_chars:
                    left = [x for x in lines if len(x) < min_chars or keeper(x.strip(b" \t\n\x0b\x0c\r").lower(), doc_id) == doc_id]
                kept.append(b"\n".join(left))
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
            struct = pa.StructArray.from_arrays(
                [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=["kept_text", "n_lines", "n_dropped"],
            )
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], struct], names=names)

    return docs.withColumn(own, F.col("doc_id").cast("long")).mapInArrow(
        cut, StructType([*docs.schema.fields, *StructType.fromDDL(f"`{into}` struct<{LINES}>").fields])
    )


def line_key(line: Column) -> Column:
    """The key of a line as a column expression."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.trim(line, F.lit(BLANKS)), upper, upper.lower())


def without_repeated_lines(docs: DataFrame, into: str, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with all its columns and a struct ``into`` of kept_text, n_lines and n_dropped (see ``dedup_lines``)."""
    suspects = written(suspect_lines(docs, min_chars), "line-suspects")
    repeated = repeated_lines(suspects, min_docs)
    if (repeated.agg(F.sum(F.octet_length("key") + 100)).first()[0] or 0) <= BROADCAST_BYTES:
        return cut_lines(docs, into, {r.key.encode(): r.keeper for r in repeated.select("key", "keeper").collect()}, min_chars)
    ids, keys = free_name(docs, "lost_id"), free_name(docs, "lost_keys")
    lost = lost_lines(suspects, repeated).select(F.col("doc_id").alias(ids), F.col("keys").alias(keys))
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    kept = F.when(F.col(keys).isNull(), lines).otherwise(F.filter(lines, lambda x: ~F.array_contains(F.col(keys), line_key(x))))
    struct = F.struct(
        F.array_join(kept, "\n").alias("kept_text"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(kept)).cast("long").alias("n_dropped"),
    )
    return docs.join(lost, F.col("doc_id").cast("long") == F.col(ids), "left").select(*docs.columns, struct.alias(into))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text) for each row of ``docs`` (doc_id, text).

    A line's key is the line without blanks at its ends and with A-Z in lower case. Keys of at least ``min_chars``
    code points that are in at least ``min_docs`` documents lose all their lines except those of the largest doc_id.
    Null or empty text is one empty line. Rows with a null doc_id neither count as documents nor lose lines; rows
    that repeat a doc_id count as one document and are treated alike. Other columns are not read.
    """
    rows = without_repeated_lines(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "lines", min_chars, min_docs)
    return rows.select("doc_id", "lines.n_lines", "lines.n_dropped", "lines.kept_text")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dedup_lines(table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2(utf8("kept_text"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
rep AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines,
       CAST(count(*) FILTER (WHERE rep.k IS NOT NULL AND doc_id <> keeper) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE rep.k IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM keyed LEFT JOIN rep ON keyed.k = rep.k
GROUP BY doc_id
"""
