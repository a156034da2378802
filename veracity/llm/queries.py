"""The numbered queries of this subpackage and their SQL."""

from __future__ import annotations

from veracity.llm import chat_format, exact_dedup, fill_in_middle, jaccard_join, katz, language_id, minhash, packing, prefix_trie, sentencepiece_lattice, token_counts, vector_search, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_near_duplicates": minhash.op2_near_duplicates,
    "op3_best_fit_packing": packing.op3_best_fit_packing,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_katz_score": katz.op5_katz_score,
    "op6_exact_top_k": vector_search.op6_exact_top_k,
    "op7_token_counts": token_counts.op7_token_counts,
    "op8_sentencepiece": sentencepiece_lattice.op8_sentencepiece,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_language_id": language_id.op10_language_id,
    "op11_ngram_join": jaccard_join.op11_ngram_join,
    "op12_prefix_trie": prefix_trie.op12_prefix_trie,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}

ORACLE_SQL = {
    "op1_warc": warc.ORACLE_SQL,
    "op4_exact_dedup": exact_dedup.ORACLE_SQL,
    "op6_exact_top_k": vector_search.ORACLE_SQL,
    "op9_chat_format": chat_format.ORACLE_SQL,
    "op12_prefix_trie": prefix_trie.ORACLE_SQL,
    "op13_fill_in_middle": fill_in_middle.ORACLE_SQL,
}
