"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import ann, conversation_repair, knn_join, license_scan, line_dedup, near_dedup, packing, period_runs, quality, sampled_pieces, substring_dedup, token_files, url_rules

QUERIES = {
    "op1_quality_classifier": quality.op1_quality_classifier,
    "op2_license_scans": license_scan.op2_license_scans,
    "op3_exact_top_k": knn_join.op3_exact_top_k,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_sentencepiece": sampled_pieces.op6_sentencepiece,
    "op7_nearest_neighbours": ann.op7_nearest_neighbours,
    "op8_token_files": token_files.op8_token_files,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_url_filters": url_rules.op10_url_filters,
    "op11_conversation_repair": conversation_repair.op11_conversation_repair,
    "op12_substring_dedup": substring_dedup.op12_substring_dedup,
    "op13_period_runs": period_runs.op13_period_runs,
}
ORACLE_SQL = {
    "op2_license_scans": license_scan.ORACLE_SQL,
    "op3_exact_top_k": knn_join.ORACLE_SQL,
    "op4_line_dedup": line_dedup.ORACLE_SQL,
    "op9_near_dedup": near_dedup.ORACLE_SQL,
    "op10_url_filters": url_rules.ORACLE_SQL,
    "op12_substring_dedup": substring_dedup.ORACLE_SQL,
}
