"""The queries of the text operators and their DuckDB SQL."""

from __future__ import annotations

from tidegate.llm import class_lm, fingerprints, language_id, line_dedup, ngram_join, one_bit_search, packing, phrases, pieces, prefix_trie, quality_rules, reply_trees, sharding

QUERIES = {
    "op1_quality_rules": quality_rules.op1,
    "op2_language_id": language_id.op2,
    "op3_chat_formatting": reply_trees.op3,
    "op4_histogram_sort_shards": sharding.op4,
    "op5_weighted_fingerprints": fingerprints.op5,
    "op6_piece_viterbi": pieces.op6,
    "op7_ngram_jaccard_join": ngram_join.op7,
    "op8_class_lm_scoring": class_lm.op8,
    "op9_best_fit_packing": packing.op9,
    "op10_line_dedup": line_dedup.op10,
    "op11_one_bit_search": one_bit_search.op11,
    "op12_phrase_collocations": phrases.op12,
    "op13_prefix_trie": prefix_trie.op13,
}

ORACLES: dict[str, str] = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op3_chat_formatting": reply_trees.OP3_SQL,
    "op10_line_dedup": line_dedup.OP10_SQL,
    "op11_one_bit_search": one_bit_search.OP11_SQL,
    "op12_phrase_collocations": phrases.OP12_SQL,
    "op13_prefix_trie": prefix_trie.OP13_SQL,
}
