"""The training-data queries and the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, decontamination, filter_audit, mixing, periodic_runs, pii, quality_classifier, quality_rules, secret_scan, simhash, substring_dedup, topk_search, url_filter


def queries() -> dict:
    return {
        "op1_url_filter": url_filter.op1_url_filter,
        "op2_secret_scan": secret_scan.op2_secret_scan,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_mixing_sources": mixing.op4_mixing_sources,
        "op5_simhash_near_dedup": simhash.op5_simhash_near_dedup,
        "op6_quality_classifier": quality_classifier.op6_quality_classifier,
        "op7_bpe_encode_decode": bpe.op7_bpe_encode_decode,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_exact_topk_search": topk_search.op9_exact_topk_search,
        "op10_pii": pii.op10_pii,
        "op11_filter_audit": filter_audit.op11_filter_audit,
        "op12_periodic_runs": periodic_runs.op12_periodic_runs,
        "op13_benchmark_decontamination": decontamination.op13_benchmark_decontamination,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """Only where SQL can express the whole operator; the others have brute-force tests in tests/llm."""
    return {
        "op9_exact_topk_search": topk_search.ORACLE_SQL,
        "op11_filter_audit": filter_audit.ORACLE_SQL,
        "op13_benchmark_decontamination": decontamination.ORACLE_SQL,
    }
