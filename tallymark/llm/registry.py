"""The operators' queries and the SQL that checks them."""

from tallymark.llm import op1_decontamination, op2_url_filter, op3_lm_score, op4_token_count, op5_quality_rules, op6_pii, op7_language_id, op8_mixing, op9_jaccard_join, op10_secret_scan, op11_prefix_trie, op12_source_divergence, op13_exact_topk

QUERIES = {
    "op1_decontamination": op1_decontamination.op1_decontamination,
    "op2_url_filter": op2_url_filter.op2_url_filter,
    "op3_lm_score": op3_lm_score.op3_lm_score,
    "op4_token_count": op4_token_count.op4_token_count,
    "op5_quality_rules": op5_quality_rules.op5_quality_rules,
    "op6_pii": op6_pii.op6_pii,
    "op7_language_id": op7_language_id.op7_language_id,
    "op8_mixing": op8_mixing.op8_mixing,
    "op9_jaccard_join": op9_jaccard_join.op9_jaccard_join,
    "op10_secret_scan": op10_secret_scan.op10_secret_scan,
    "op11_prefix_trie": op11_prefix_trie.op11_prefix_trie,
    "op12_source_divergence": op12_source_divergence.op12_source_divergence,
    "op13_exact_topk": op13_exact_topk.op13_exact_topk,
}

ORACLES = {"op9_jaccard_join": op9_jaccard_join.ORACLE_SQL, "op11_prefix_trie": op11_prefix_trie.ORACLE_SQL, "op12_source_divergence": op12_source_divergence.ORACLE_SQL, "op13_exact_topk": op13_exact_topk.ORACLE_SQL}
