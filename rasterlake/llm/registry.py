"""Queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from rasterlake.llm import binary, decontaminate, jaccard, lexical, licenses, lines, passages, periodic, quality, token_counts, topk, url_filter

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_licenses": licenses.op2_licenses,
    "op3_packing": binary.op3_packing,
    "op4_token_binary": binary.op4_token_binary,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_passages": passages.op6_passages,
    "op7_exact_topk": topk.op7_exact_topk,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_url_filter": url_filter.op9_url_filter,
    "op10_jaccard_join": jaccard.op10_jaccard_join,
    "op11_periodic_runs": periodic.op11_periodic_runs,
    "op12_token_counts": token_counts.op12_token_counts,
    "op13_lexical_search": lexical.op13_lexical_search,
}
ORACLES = {"op7_exact_topk": topk.ORACLE, "op5_line_dedup": lines.ORACLE, "op9_url_filter": url_filter.ORACLE, "op13_lexical_search": lexical.ORACLE}
