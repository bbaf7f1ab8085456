"""Queries and DuckDB SQL of the training-data operators."""

from __future__ import annotations

from tarn.llm import bpe, exact_dedup, html_text, jaccard_join, license_scan, line_dedup, mixing, quality_model, quality_rules, toxicity

QUERIES = {
    "op1_bpe": bpe.query,
    "op2_source_mixing": mixing.query,
    "op3_line_dedup": line_dedup.query,
    "op4_license_scan": license_scan.query,
    "op5_quality_classifier": quality_model.query,
    "op6_quality_rules": quality_rules.query,
    "op7_html_extraction": html_text.query,
    "op8_ngram_jaccard_join": jaccard_join.query,
    "op9_toxicity": toxicity.query,
    "op10_exact_dedup": exact_dedup.query,
}

ORACLE_SQL = {
    "op2_source_mixing": mixing.SQL,
    "op3_line_dedup": line_dedup.SQL,
    "op4_license_scan": license_scan.SQL,
    "op10_exact_dedup": exact_dedup.SQL,
}
