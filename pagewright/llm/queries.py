"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import (
    chat,
    decontamination,
    fill_middle,
    hard_negatives,
    html_extraction,
    line_dedup,
    oracle,
    packing,
    pii,
    quality_classifier,
    quality_rules,
    simhash,
    toxicity,
    url_reputation,
)

QUERIES = {
    "op1_pattern_packing": packing.op1_pattern_packing,
    "op2_host_reputation": url_reputation.op2_host_reputation,
    "op3_simhash_bktree": simhash.op3_simhash_bktree,
    "op4_adaptive_rules": quality_rules.op4_adaptive_rules,
    "op5_toxic_segments": toxicity.op5_toxic_segments,
    "op6_hierarchical_quality": quality_classifier.op6_hierarchical_quality,
    "op7_schema_chat": chat.op7_schema_chat,
    "op8_line_hashing": line_dedup.op8_line_hashing,
    "op9_simhash_decontamination": decontamination.op9_simhash_decontamination,
    "op10_disclosure": pii.op10_disclosure,
    "op11_dom_crf": html_extraction.op11_dom_crf,
    "op12_piece_table": fill_middle.op12_piece_table,
    "op13_one_bit_codes": hard_negatives.op13_one_bit_codes,
}
ORACLES = {
    "op2_host_reputation": oracle.REPUTATION,
    "op4_adaptive_rules": oracle.RULES,
    "op7_schema_chat": oracle.CHAT,
    "op12_piece_table": oracle.FILL_IN_MIDDLE,
    "op13_one_bit_codes": oracle.HARD_NEGATIVES,
}
