import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from hostlore.llm.decontaminate import find_contamination
from hostlore.llm.fertility import apply_rules
from hostlore.llm.line_dedup import dedup_lines
from hostlore.llm.minhash import near_duplicates

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    columns = docs.columns
    ids = lambda df: {r[0] for r in df.select("doc_id").collect()}

    kept = cp.written(cp.quality_rules(spark, docs, SF), "t1")
    assert kept.columns == columns and ids(kept) == ids(apply_rules(docs).where("kept"))
    lines = cp.written(cp.line_dedup(spark, kept, SF), "t2")
    assert lines.columns == columns and lines.schema == docs.schema
    want = {r.doc_id: r.kept_text for r in dedup_lines(kept).collect()}
    assert {r.doc_id: r.text for r in lines.collect()} == want and all(r.n_chars == len(r.text) for r in lines.collect())
    near = cp.written(cp.near_dedup(spark, lines, SF), "t3")
    assert near.columns == columns and ids(near) == ids(near_duplicates(lines).where("kept"))
    clean = cp.written(cp.decontaminate(spark, near, SF), "t4")
    assert clean.columns == columns and ids(clean) == ids(find_contamination(near, bench).where("not contaminated"))
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in cp.packing(spark, clean, SF).collect():
        pieces[r.doc_id].append(r)
    for r in clean.collect():
        tokens = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[r.doc_id], key=lambda p: p.start)
        assert sum(p.length for p in own) == tokens.size
        assert all(zlib.crc32(tokens[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own)


def test_odd_rows_and_names(spark):
    """Null ids and texts, repeated ids and rows, columns named like those made inside: what each stage does with them."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = cp.quality_rules(spark, docs, SF).first().text
    rows = [(None, good), (None, "two words"), (None, None), (10**9, good), (10**9, "short"), (10**9 + 1, good), (10**9 + 1, good)]
    names = ["rules", "bands", "lines", "found", "body", "kept_text", "n_lines", "n_dropped", "kept", "component_id"]
    odd = spark.createDataFrame(
        [(i, t, "en", "x", len(t or ""), k) for k, (i, t) in enumerate(rows)],
        "doc_id long, text string, lang string, source string, n_chars int, k int",
    )
    both = docs.selectExpr("*", "-1 k").unionByName(odd)
    both = both.selectExpr("*", *(f"'{n}' as {n}" for n in names))
    left = [set(range(7)), {0, 3, 5, 6}, {0, 3, 5, 6}, {0}, {0}]
    for (_, stage), want in zip(cp.STAGES[:-1], left[1:], strict=True):
        both = cp.written(stage(spark, both, SF), "odd")
        assert both.columns == [*docs.columns, "k", *names]
        got = both.where("k >= 0").collect()
        assert {r.k for r in got} <= want if stage is cp.near_dedup else {r.k for r in got} == want
        assert all(r[n] == n for r in got for n in names)
    packed = cp.packing(spark, both, SF)
    assert packed.where("doc_id is null").count() >= 1


def test_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in cp.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
