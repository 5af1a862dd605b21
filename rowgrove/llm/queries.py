"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import chat_format, collision_search, decontamination, html_extract, language_id, packing, quality, simhash, token_counts, url_rules

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_chat_format": chat_format.op3_chat_format,
    "op5_url_rules": url_rules.op5_url_rules,
    "op4_decontamination": decontamination.op4_decontamination,
    "op6_quality": quality.op6_quality,
    "op7_collision_search": collision_search.op7_collision_search,
    "op8_packing": packing.op8_packing,
    "op9_simhash": simhash.op9_simhash,
    "op10_language_id": language_id.op10_language_id,
}

ORACLES = {**chat_format.ORACLE, **decontamination.ORACLE, **url_rules.ORACLE}
