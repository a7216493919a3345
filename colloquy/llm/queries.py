"""The operators as queries over the given tables, and SQL where it can say the same."""

from __future__ import annotations

from colloquy.llm import (
    centroids, jaccard_join, licenses, multi_index, packing, prefix_trie, quality_cascade, rank_queue_bpe,
    suffix_dedup, token_counts, token_files, toxicity, url_templates,
)

QUERIES = {
    "op1_quality_rules": quality_cascade.op1_quality_rules,
    "op2_embedding_near_dedup": multi_index.op2_embedding_near_dedup,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_ngram_jaccard": jaccard_join.op4_ngram_jaccard,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_byte_bpe": rank_queue_bpe.op7_byte_bpe,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_url_filters": url_templates.op9_url_filters,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_centroid_clusters": centroids.op11_centroid_clusters,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_token_files": token_files.op13_token_files,
}

ORACLES = {
    "op1_quality_rules": quality_cascade.ORACLE,
    "op2_embedding_near_dedup": multi_index.ORACLE,
    "op4_ngram_jaccard": jaccard_join.ORACLE,
    "op11_centroid_clusters": centroids.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
