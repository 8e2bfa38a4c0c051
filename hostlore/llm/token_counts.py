"""Token counts by a tokenizer compiled to finite-state machines (see ``transducer``)."""

from __future__ import annotations

from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlore.llm.common import release, table
from hostlore.llm.transducer import compiled

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024


def count_tokens(docs: DataFrame, vocabulary: str | None = None, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs`` (doc_id, text).

    Counts are those of the tokenizer file without added special tokens. Null texts count as empty, with no tokens;
    repeated rows each get a row; other columns are not read. ``vocabulary`` is a path that every executor has,
    by default the installed byte-level vocabulary. One process holds the machine's states (about MAX_STATES at most, then
    started anew) and one batch of text; nothing is shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = compiled(vocabulary or public_tokenizers.path(VOCABULARY))
        for batch in batches:
            counts = machine.counts([t or "" for t in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts)], names=["doc_id", "n_bytes", "n_tokens"])
        release()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
