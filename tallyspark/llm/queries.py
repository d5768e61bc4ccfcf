"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tallyspark.llm import filter_audit, fuzzy, jaccard_join, line_dedup, media, packing, suffix_dedup, token_files, toxicity, unigram, url_filter, word_runs

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_ngram_jaccard_join": jaccard_join.op2_ngram_jaccard_join,
    "op3_nbest_segmentation": unigram.op3_nbest_segmentation,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_token_files": token_files.op5_token_files,
    "op6_media_columns": media.op6_media_columns,
    "op7_url_filters": url_filter.op7_url_filters,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_token_counts": unigram.op9_token_counts,
    "op10_document_fingerprints": fuzzy.op10_document_fingerprints,
    "op11_suffix_array_dedup": suffix_dedup.op11_suffix_array_dedup,
    "op12_periodic_runs": word_runs.op12_periodic_runs,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard_join": jaccard_join.OP2_SQL, "op4_line_dedup": line_dedup.OP4_SQL, "op11_suffix_array_dedup": suffix_dedup.OP11_SQL, "op13_filter_audit": filter_audit.OP13_SQL}
