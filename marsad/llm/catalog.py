"""Queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from marsad.llm import ann_forest, bpe, packing, quality_forest, secret_scan, simhash, substring_dedup, suffix_dedup, url_filter

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_bpe_codec": bpe.op5_bpe_codec,
    "op6_quality_forest": quality_forest.op6_quality_forest,
    "op7_simhash": simhash.op7_simhash,
    "op8_retrieval_packing": packing.op8_retrieval_packing,
    "op9_ann_forest": ann_forest.op9_ann_forest,
    "op10_token_output": packing.op10_token_output,
}
SQL = {"op2_url_filter": url_filter.OP2_SQL}
