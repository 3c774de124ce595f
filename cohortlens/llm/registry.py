"""Queries of the ten operators and of the pipeline, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import best_fit_packing, content_sort_dedup, inverted_multi_index, jaccard_join, language_id, merge_dropout, pii_bootstrap, rendezvous_sharding, suffix_dedup, tool_calls


def queries() -> dict:
    import corpus_pipeline

    return {
        "pipeline": corpus_pipeline.run,
        "op2_content_sort": content_sort_dedup.op2_content_sort,
        "op4_rendezvous": rendezvous_sharding.op4_rendezvous,
        "op5_config_lp": best_fit_packing.op5_config_lp,
        "op7_language_id": language_id.op7_language_id,
        "op10_pii": pii_bootstrap.op10_pii,
        "op3_jaccard_join": jaccard_join.op3_jaccard_join,
        "op9_multi_index": inverted_multi_index.op9_multi_index,
        "op8_suffix_dedup": suffix_dedup.op8_suffix_dedup,
        "op6_merge_dropout": merge_dropout.op6_merge_dropout,
        "op1_tool_calls": tool_calls.op1_tool_calls,
    }


def oracle_sql() -> dict:
    return {"op1_tool_calls": tool_calls.ORACLE, "op2_content_sort": content_sort_dedup.ORACLE, "op3_jaccard_join": jaccard_join.ORACLE}
