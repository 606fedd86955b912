"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import clusters, exact, langid, ngram_join, packing, pieces, pii, quality_model, quality_rules, substring_dedup, token_files, url_filter, vector_codes

QUERIES = {
    "op1_packing": packing.query,
    "op2_sentencepiece": pieces.query,
    "op3_language_id": langid.query,
    "op4_quality_rules": quality_rules.query,
    "op5_quality_classifier": quality_model.query,
    "op6_ngram_jaccard_join": ngram_join.query,
    "op7_pii": pii.query,
    "op8_substring_dedup": substring_dedup.query,
    "op9_exact_dedup": exact.query,
    "op10_url_filters": url_filter.query,
    "op11_token_files": token_files.query,
    "op12_vector_codes": vector_codes.query,
    "op13_centroid_clusters": clusters.query,
}

SQL = {
    "op6_ngram_jaccard_join": ngram_join.SQL,
    "op9_exact_dedup": exact.SQL,
    "op10_url_filters": url_filter.SQL,
    "op11_token_files": token_files.query,
    "op12_vector_codes": vector_codes.SQL,
    "op13_centroid_clusters": clusters.SQL,
}
