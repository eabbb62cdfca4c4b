"""The queries and SQL of this subpackage, by name."""

from __future__ import annotations

from tidewater.llm import decontamination, exact_dedup, hard_negatives, language_id, license_scan, lm_scoring, mixing, near_dedup, quality, resampling, sentence_pieces, sharding, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_quality": quality.op2_quality,
    "op3_language_id": language_id.op3_language_id,
    "op4_lm_scoring": lm_scoring.op4_lm_scoring,
    "op5_decontamination": decontamination.op5_decontamination,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_mixing": mixing.op9_mixing,
    "op10_sharding": sharding.op10_sharding,
    "op11_resampling": resampling.op11_resampling,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_sentence_pieces": sentence_pieces.op13_sentence_pieces,
}

SQL = {
    "op5_decontamination": decontamination.OP5_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op9_mixing": mixing.OP9_SQL,
    "op11_resampling": resampling.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
}
