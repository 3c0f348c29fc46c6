"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from ledgerlake.llm import ann, exact_dedup, hard_negatives, language_id, mixing, ngram_join, packing, quality
from ledgerlake.llm import substring_dedup, token_counts, topk, url_filter, whitening

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_quality_classifier": quality.op5_quality_classifier,
    "op6_source_mixing": mixing.op6_source_mixing,
    "op7_exact_top_k": topk.op7_exact_top_k,
    "op8_language_id": language_id.op8_language_id,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
    "op11_nearest_neighbours": ann.op11_nearest_neighbours,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}
SQL = {
    "op2_url_filter": url_filter.SQL,
    "op3_exact_dedup": exact_dedup.SQL,
    "op7_exact_top_k": topk.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
}
