"""Registered queries of this package, and the SQL they are checked against where SQL can express them."""

from __future__ import annotations

from shardloom.llm import (
    bpe, decontaminate, jaccard_join, language, licenses, nearest, quality, sharding, substring_dedup, token_files, trie,
    url_filter, vector_codes,
)

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_nearest": nearest.op2_nearest,
    "op3_license_scan": licenses.op3_license_scan,
    "op4_sharding": sharding.op4_sharding,
    "op5_bpe": bpe.op5_bpe,
    "op6_url_filter": url_filter.op6_url_filter,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_token_files": token_files.op8_token_files,
    "op9_language_id": language.op9_language_id,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_quality": quality.op12_quality,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

SQL: dict[str, str] = {
    "op1_decontaminate": decontaminate.SQL,
    "op11_prefix_trie": trie.SQL,
    "op13_vector_codes": vector_codes.SQL,
}
