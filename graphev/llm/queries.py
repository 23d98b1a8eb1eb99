"""The registered queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from graphev.llm import chat_format, cover_tree, decontaminate, divergence, exact_dedup, line_dedup, oracles, packing, period_runs, sharding, simhash_dedup, token_counts, toxicity, url_filter

QUERIES = {
    "op1_url_filter": url_filter.op1_url_filter,
    "op2_feistel_shards": sharding.op2_feistel_shards,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_simhash_dedup": simhash_dedup.op7_simhash_dedup,
    "op8_chat_format": chat_format.op8_chat_format,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_retrieval_packing": packing.op10_retrieval_packing,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_embedding_dedup": cover_tree.op12_embedding_dedup,
    "op13_period_runs": period_runs.op13_period_runs,
}

ORACLES = {
    "op1_url_filter": oracles.url_filter_sql(),
    "op4_line_dedup": oracles.line_dedup_sql(),
    "op5_exact_dedup": oracles.EXACT_DEDUP_SQL,
    "op8_chat_format": oracles.chat_format_sql(),
    "op11_source_divergence": oracles.SOURCE_DIVERGENCE_SQL,
    "op12_embedding_dedup": oracles.EMBEDDING_DEDUP_SQL,
    "op13_period_runs": oracles.PERIOD_RUNS_SQL,
}
