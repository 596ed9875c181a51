"""The queries of this subpackage and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from evalfold.llm import decontaminate, exact_dedup, fill_in_middle, license_scan, line_dedup, near_dedup, periodic_runs, quality, secret_scan, sentence_pieces, sharding, token_counts, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_sharding": sharding.op2_sharding,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_sentence_pieces": sentence_pieces.op6_sentence_pieces,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_quality": quality.op8_quality,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_secret_scan": secret_scan.op10_secret_scan,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_periodic_runs": periodic_runs.op12_periodic_runs,
    "op13_toxicity": toxicity.op13_toxicity,
}

ORACLES = {
    "op1_exact_dedup": exact_dedup.ORACLE, "op3_near_dedup": near_dedup.ORACLE, "op7_decontamination": decontaminate.ORACLE, "op9_line_dedup": line_dedup.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
}
