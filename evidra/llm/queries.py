"""Queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from . import decontam, filter_audit, hmm_score, hnsw, knn_quality, language_id, line_dedup, packing, periodic, quality_rules, simhash, substring_dedup, warc

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_hmm_score": hmm_score.query,
    "op3_knn_quality": knn_quality.query,
    "op4_substring_dedup": substring_dedup.query,
    "op5_simhash": simhash.query,
    "op6_vector_best_fit": packing.query,
    "op7_line_dedup": line_dedup.query,
    "op8_language_id": language_id.query,
    "op9_warc_index": warc.query,
    "op10_decontamination": decontam.query,
    "op11_periodic_runs": periodic.query,
    "op12_filter_audit": filter_audit.query,
    "op13_hnsw": hnsw.query,
}

ORACLES = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op4_substring_dedup": substring_dedup.ORACLE,
    "op7_line_dedup": line_dedup.ORACLE,
    "op9_warc_index": warc.ORACLE,
    "op12_filter_audit": filter_audit.ORACLE,
}
