"""Queries of this subpackage and the DuckDB statements for those that SQL can express."""

from __future__ import annotations

from demandspark.llm import bpe, decontamination, embedding_dedup, language_id, line_dedup, minhash, phrases, pii, quality, substring_dedup, suffix_dedup, url_filter, vector_codes

QUERIES = {
    "op1_embedding_dedup": embedding_dedup.op1_embedding_dedup,
    "op2_url_filters": url_filter.op2_url_filters,
    "op3_language_id": language_id.op3_language_id,
    "op4_pii": pii.op4_pii,
    "op5_bpe": bpe.op5_bpe,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_minhash": minhash.op8_minhash,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_quality": quality.op11_quality,
    "op12_phrases": phrases.op12_phrases,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}
ORACLE = {
    "op1_embedding_dedup": embedding_dedup.SQL,
    "op2_url_filters": url_filter.SQL,
    "op6_substring_dedup": substring_dedup.SQL,
    "op7_decontamination": decontamination.SQL,
    "op8_minhash": minhash.SQL,
    "op9_line_dedup": line_dedup.SQL,
    "op10_suffix_dedup": suffix_dedup.SQL,
    "op12_phrases": phrases.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
