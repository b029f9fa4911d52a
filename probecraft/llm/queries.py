"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import op1_licenses, op2_chat, op3_language_id, op4_jaccard_join, op5_ann, op6_bpe, op7_token_files, op8_suffix_dedup, op9_quality_rules, op10_mixing

QUERIES = {
    "op1_license_scan": op1_licenses.query,
    "op2_chat_format": op2_chat.query,
    "op3_language_id": op3_language_id.query,
    "op4_jaccard_join": op4_jaccard_join.query,
    "op5_nearest_neighbours": op5_ann.query,
    "op6_bpe": op6_bpe.query,
    "op7_token_files": op7_token_files.query,
    "op8_suffix_dedup": op8_suffix_dedup.query,
    "op9_quality_rules": op9_quality_rules.query,
    "op10_mixing": op10_mixing.query,
}

ORACLES = {"op9_quality_rules": op9_quality_rules.SQL}
