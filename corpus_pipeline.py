"""A training-corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes ``(spark, docs, sf_dir)`` and works on everything the stage before kept. The rules and the
decontamination judge each row on its own text, and no row is shuffled for that. Line and near-duplicate stages decide by
doc_id: rows that repeat one share the decisions made for it, and a row with a null doc_id is left as it is. Any other
columns of the input pass through all stages but the last, whatever their names. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostlore.llm.common import free_name, table, written
from hostlore.llm.decontaminate import clean_documents
from hostlore.llm.fertility import keep_good
from hostlore.llm.line_dedup import without_repeated_lines
from hostlore.llm.minhash import near_duplicates
from hostlore.llm.packing import pack_documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text a rule or a fertility band rejects go, null and empty texts among them."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; texts and their lengths change, rows stay. A text that loses no line is as it was, null too."""
    into = free_name(docs, "lines")
    lines = without_repeated_lines(docs, into)
    changed = F.col(f"{into}.n_dropped") > 0
    new = {"text": F.when(changed, F.col(f"{into}.kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(changed, F.length(f"{into}.kept_text").cast(kind)).otherwise(F.col("n_chars"))
    return lines.withColumns(new).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id; null and empty texts stay."""
    gone = written(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "duplicates")
    return docs.join(gone, "doc_id", "left_anti").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds passages of the benchmark go."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes pieces of token sequences."""
    return pack_documents(docs)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("near dedup", near_dedup), ("decontamination", decontaminate), ("packing", packing)]
#: Tokens decide in the first and the last stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
