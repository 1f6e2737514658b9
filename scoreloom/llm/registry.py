"""The queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

from . import chat_format, decontamination, exact_dedup, html_extract, jaccard_join, language_id, language_model, license_scan, line_dedup, merkle_manifest, mixing, token_alignment, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup,
    "op2_exact_dedup": exact_dedup,
    "op3_license_scan": license_scan,
    "op4_toxicity": toxicity,
    "op5_mixing": mixing,
    "op6_decontamination": decontamination,
    "op7_language_id": language_id,
    "op8_html_extract": html_extract,
    "op9_jaccard_join": jaccard_join,
    "op10_chat_format": chat_format,
    "op11_token_alignment": token_alignment,
    "op12_merkle_manifest": merkle_manifest,
    "op13_lm_scoring": language_model,
}


def queries():
    return {name: module.query for name, module in QUERIES.items()}


def oracle_sql():
    return {name: module.SQL for name, module in QUERIES.items() if getattr(module, "SQL", None)}
