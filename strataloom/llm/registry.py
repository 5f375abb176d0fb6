"""Queries of the subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import binary_ids, collocations, exact_dedup, hidden_markov, merkle, mixing, near_dedup, packing, quality, suffix_dedup, token_counts, tool_calls, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """The operators by query name."""
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_binary_ids": binary_ids.op3_binary_ids,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_mixing": mixing.op6_mixing,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_quality_rules": quality.op8_quality_rules,
        "op9_tool_calls": tool_calls.op9_tool_calls,
        "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
        "op11_collocations": collocations.op11_collocations,
        "op12_merkle_manifest": merkle.op12_merkle_manifest,
        "op13_hidden_markov": hidden_markov.op13_hidden_markov,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the operators that SQL can express."""
    return {
        "op2_exact_dedup": exact_dedup.OP2_SQL,
        "op6_mixing": mixing.OP6_SQL,
        "op8_quality_rules": quality.OP8_SQL,
        "op9_tool_calls": tool_calls.OP9_SQL,
        "op11_collocations": collocations.OP11_SQL,
        "op12_merkle_manifest": merkle.OP12_SQL,
    }
