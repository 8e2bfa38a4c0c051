"""Source divergence audit: how far the sources of a language are from one another, and which terms set a source apart.

1. One pass over the texts counts terms by (language, source); tasks add up what they read, Spark sums the rest.
2. The kept terms of a language are cut into term blocks and its sources into group blocks. A *slice* is what the sources
   of one group block have in one term block: a small dense table of probabilities.
3. Each slice is sent to all *cells* (group block, group block, term block) that it is part of. A cell has two slices at
   most, computes the partial divergences of its pairs of sources, and these are summed along the term axis.

A term that neither of two sources has differs by the same amount in each place, so cells only add what their terms differ
from that; the number of kept terms times that amount is added once, in the first term block.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hostlore.llm.common import join_weighted, release, table, term_lists, terms_table, text_groups, written
from hostlore.llm.seen_twice import packed, unpacked

MIN_DOCS = 30
TOP_TERMS = 50
#: Probabilities are whole numbers of this many parts, with PRIOR added to each count.
PARTS, PRIOR = 1_000_000_000, 5
#: Sources and terms of a slice, about.
GROUP_BLOCK, TERM_BLOCK = 16, 1024
#: Entries that a task holds before it passes its counts on.
HELD = 400_000
LETTERS = terms_table(range(0x41, 0x5B), range(0x61, 0x7B))
COUNTS = "lang string, source string, term string, n long, n_docs long"


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, term, occurrences, documents) of (text, lang, source); a group's own row has the empty term."""
    held: dict[tuple, tuple[Counter, Counter]] = {}
    size = 0

    def passed_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            terms = list(docs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * len(terms), pa.string()),
                    pa.array([source] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()).cast(pa.string()),
                    pa.array([n[t] for t in terms], pa.int64()),
                    pa.array(list(docs.values()), pa.int64()),
                ],
                names=["lang", "source", "term", "n", "n_docs"],
            )

    for part, texts in text_groups(batches, 0):
        for text, lang, source in zip(texts, part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
            n, docs = held.setdefault((lang or "", source or ""), (Counter(), Counter()))
            before, own = len(docs), {b""}
            for words in term_lists(text, LETTERS):
                n.update(words)
                own.update(words)
            docs.update(own)
            size += len(docs) - before
            if size > HELD:
                yield from passed_on()
                held, size = {}, 0
    yield from passed_on()
    release()


def term_counts(docs: DataFrame) -> DataFrame:
    """``count_terms`` summed: one row for each (lang, source, term), written."""
    each = docs.select(F.col("text"), F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(count_terms, COUNTS)
    return written(each.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")), "term-counts")


def share(count: Column, total: Column) -> Column:
    """1 + floor(PARTS * (count + PRIOR) / total), exact at any size."""
    parts = (count + PRIOR).cast("decimal(20,0)") * F.lit(PARTS).cast("decimal(10,0)")
    return F.call_function("div", parts, total.cast("decimal(20,0)")) + 1


def pack_slice(key: tuple, rows: pa.Table) -> pa.Table:
    """One row for a group block's part of a term block. Rows without ``place`` name the sources and the share of what they lack."""
    place = rows.column("place")
    own = rows.filter(pc.is_null(place))
    sources = own.column("source").to_pylist()
    order = sorted(range(len(sources)), key=lambda i: sources[i].encode())
    sources = [sources[i] for i in order]
    absent = own.column("p").to_numpy()[order]
    has = rows.filter(pc.is_valid(place))
    at = {s: i for i, s in enumerate(sources)}
    column = has.column("place").to_numpy().astype(np.int64)
    cells = np.repeat(absent[:, None], int(column.max(initial=-1)) + 1, axis=1)
    cells[np.fromiter((at[s] for s in has.column("source").to_pylist()), np.int64, len(column)), column] = has.column("p").to_numpy()
    lang, group, block = (k.as_py() for k in key)
    return pa.table(
        {
            "lang": pa.array([lang], pa.string()),
            "group_block": pa.array([group], pa.int64()),
            "term_block": pa.array([block], pa.int64()),
            "group_blocks": pa.array([own.column("group_blocks")[0].as_py()], pa.int64()),
            "kept": pa.array([own.column("kept")[0].as_py()], pa.int64()),
            "sources": pa.array([sources], pa.list_(pa.string())),
            "absent": pa.array([absent.tobytes()], pa.binary()),
            "cells": pa.array([packed(cells)], pa.binary()),
        }
    )


SLICE = "lang string, group_block long, term_block long, group_blocks long, kept long, sources array<string>, absent binary, cells binary"


def opened(row: dict) -> tuple[list[str], np.ndarray, np.ndarray]:
    absent = np.frombuffer(row["absent"], np.int64)
    return row["sources"], absent, unpacked(row["cells"], np.int64).reshape(len(absent), -1)


def widened(cells: np.ndarray, absent: np.ndarray, width: int) -> np.ndarray:
    return np.hstack([cells, np.repeat(absent[:, None], width - cells.shape[1], axis=1)])


def cell_divergence(key: tuple, rows: pa.Table) -> pa.Table:
    """Partial divergences of the pairs of sources in a cell: a block against itself, or against another one that has sources."""
    slices = sorted(rows.to_pylist(), key=lambda r: r["group_block"])
    same = key[1] == key[2]
    if not same and len(slices) == 1:
        return pa.table([pa.array([], k) for k in (pa.string(), pa.string(), pa.string(), pa.int64())], names=["lang", "a", "b", "part"])
    a, absent_a, p = opened(slices[0])
    b, absent_b, q = opened(slices[-1])
    width = max(p.shape[1], q.shape[1])
    p, q = widened(p, absent_a, width), widened(q, absent_b, width)
    # the first term block also has what all terms add that no cell counts
    lacking = (slices[0]["kept"] if slices[0]["term_block"] == 0 else 0) - width
    left, right, part = [], [], []
    for i, name in enumerate(a):
        first = i + 1 if same else 0
        if first >= len(b):
            continue
        total = np.abs(q[first:] - p[i]).sum(axis=1) + lacking * np.abs(absent_b[first:] - absent_a[i])
        left += [name] * len(total)
        right += b[first:]
        part.append(total)
    return pa.table(
        {
            "lang": pa.array([slices[0]["lang"]] * len(left), pa.string()),
            "a": pa.array(left, pa.string()),
            "b": pa.array(right, pa.string()),
            "part": pa.array(np.concatenate([np.zeros(0, np.int64), *part]), pa.int64()),
        }
    )


def blocks_of(count: Column, size: int) -> Column:
    return F.greatest(F.lit(1), F.ceil(count / size)).cast("long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, group_block: int = GROUP_BLOCK, term_block: int = TERM_BLOCK) -> DataFrame:
    """(lang, source, part, item, value, rank) of the groups (lang, source) of ``docs`` (text, lang, source).

    Part ``pair``: every other source of the language by falling divergence. Part ``term``: the ``top`` terms that the
    source has more of than its language. Terms are runs of letters and non-ASCII characters, A-Z in lower case, kept
    if ``min_docs`` documents of the language have them. Null text, language and source are empty ones; repeated rows
    count each; a group without terms, or a language without kept terms, has its pairs all the same (of value 0 where no
    term is kept). Equal values rank by the item's UTF-8 bytes. An empty table has no rows. Other columns are not read.
    """
    counts = term_counts(docs)
    terms = counts.where("term <> ''")
    kept = terms.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("n_docs").alias("n_docs")).where(F.col("n_docs") >= min_docs)
    kept = written(kept.drop("n_docs"), "kept-terms")
    groups = counts.where("term = ''").select("lang", "source")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("n_groups")).join(sizes, "lang", "left").na.fill(0, ["kept", "lang_total"])
    langs = written(
        langs.withColumns({"group_blocks": blocks_of(F.col("n_groups"), group_block), "term_blocks": blocks_of(F.col("kept"), term_block)}), "languages"
    )

    block = F.pmod(F.xxhash64("term"), F.col("term_blocks"))
    placed = join_weighted(kept, langs.select("lang", "term_blocks", F.col("kept").alias("w")), "lang", "w").withColumn("term_block", block)
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("lang", "term_block").orderBy("term")) - 1).drop("term_blocks")
    rows = written(terms.select("lang", "source", "term", "n").join(placed, ["lang", "term"]), "kept-counts")

    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("n_terms"))
    whole = F.col("total") + PRIOR * F.col("kept")
    group = join_weighted(groups, langs, "lang", "n_groups").join(totals, ["lang", "source"], "left").na.fill(0, ["total", "n_terms"])
    group = written(group.withColumns({"group_block": F.pmod(F.xxhash64("source"), F.col("group_blocks")), "whole": whole}), "groups")

    sides = group.where("n_terms > 0").select(
        "lang", "source", "group_block", "whole", (F.col("lang_total") + PRIOR * F.col("kept")).alias("lang_whole"), "n_terms"
    )
    known = join_weighted(rows, sides, ["lang", "source"], "n_terms")
    known = known.withColumns({"p": share(F.col("n"), F.col("whole")), "q": share(F.col("in_lang"), F.col("lang_whole"))})

    absent = F.when(F.col("kept") > 0, share(F.lit(0), F.col("whole"))).otherwise(F.lit(0).cast("long"))
    first = F.lit(0).cast("long")
    every_block = F.explode(F.sequence(first, F.col("term_blocks") - 1)).alias("term_block")
    own = group.select("lang", "source", "group_block", "group_blocks", "kept", absent.alias("p"), every_block)
    parts = known.select("lang", "source", "group_block", "term_block", "p", "place").unionByName(own, allowMissingColumns=True)
    slices = parts.groupBy("lang", "group_block", "term_block").applyInArrow(pack_slice, SLICE)
    slices = written(slices, "slices")
    sent = slices.withColumn("other", F.explode(F.sequence(first, F.col("group_blocks") - 1)))
    sent = sent.withColumns({"low": F.least("group_block", "other"), "high": F.greatest("group_block", "other")}).drop("other", "group_blocks")
    partial = sent.groupBy("lang", "low", "high", "term_block").applyInArrow(cell_divergence, "lang string, a string, b string, part long")
    value = partial.groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = value.select("lang", both.alias("s"), "value").select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value")

    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    above = known.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return pairs.withColumn("rank", rank).unionByName(above.withColumn("rank", rank).where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
k AS (SELECT lang, term, count(*) AS c FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
v AS (SELECT lang, count(*) AS v, sum(c) AS n FROM k GROUP BY lang),
n AS (SELECT t.lang, t.source, t.term, count(*) AS c FROM t JOIN k ON t.lang = k.lang AND t.term = k.term GROUP BY t.lang, t.source, t.term),
ng AS (SELECT g.lang, g.source, coalesce(sum(n.c), 0) AS n FROM g LEFT JOIN n ON g.lang = n.lang AND g.source = n.source GROUP BY g.lang, g.source),
p AS (
  SELECT ng.lang, ng.source, k.term, coalesce(n.c, 0) AS c, 1 + (1000000000 * (coalesce(n.c, 0) + 5)) // (ng.n + 5 * v.v) AS p,
         1 + (1000000000 * (k.c + 5)) // (v.n + 5 * v.v) AS q
  FROM ng JOIN v ON ng.lang = v.lang JOIN k ON k.lang = ng.lang LEFT JOIN n ON n.lang = ng.lang AND n.source = ng.source AND n.term = k.term),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term
    AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(far.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
