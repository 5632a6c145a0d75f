"""Queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import chat, decontaminate, hard_negatives, html, line_dedup, merkle, neardup, packing, quality, suffix_dedup, token_counts, token_files, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_html_extraction": html.query,
    "op3_best_fit_packing": packing.query,
    "op4_suffix_array_dedup": suffix_dedup.query,
    "op5_minhash_near_dedup": neardup.query,
    "op6_toxicity": toxicity.query,
    "op7_chat_formatting": chat.query,
    "op8_decontamination": decontaminate.query,
    "op9_token_files": token_files.query,
    "op10_quality_rules": quality.query,
    "op11_token_counts": token_counts.query,
    "op12_merkle_manifest": merkle.query,
    "op13_hard_negatives": hard_negatives.query,
}
ORACLES = {"op1_line_dedup": line_dedup.ORACLE, "op7_chat_formatting": chat.ORACLE, "op12_merkle_manifest": merkle.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
