"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from hostlore.llm import (
    decontaminate,
    divergence,
    fertility,
    lexical_search,
    line_dedup,
    lm_score,
    minhash,
    packing,
    quality_classifier,
    secret_scan,
    suffix_dedup,
    token_counts,
    warc,
)

MODULES = {
    "op1_fertility_rules": fertility,
    "op2_seekable_warc": warc,
    "op3_quality_classifier": quality_classifier,
    "op4_decontaminate": decontaminate,
    "op5_token_counts": token_counts,
    "op6_masked_lm_score": lm_score,
    "op7_line_dedup": line_dedup,
    "op8_suffix_dedup": suffix_dedup,
    "op9_harmonic_packing": packing,
    "op10_near_duplicates": minhash,
    "op11_pair_bound_search": lexical_search,
    "op12_secret_scan": secret_scan,
    "op13_source_divergence": divergence,
}


def queries() -> dict:
    return {name: getattr(module, name) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in MODULES.items() if hasattr(module, "ORACLE")}
