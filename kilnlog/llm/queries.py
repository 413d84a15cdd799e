"""The training-data queries and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kilnlog.llm import chosen_path, fingerprints, line_dedup, mixing, quality, sentencepiece_scan, token_counts, tool_chat, topk, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_fingerprints": fingerprints.op2_fingerprints,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_exact_topk": topk.op4_exact_topk,
        "op5_quality_classifier": quality.op5_quality_classifier,
        "op6_sentencepiece": sentencepiece_scan.op6_sentencepiece,
        "op7_tool_chat": tool_chat.op7_tool_chat,
        "op8_ngram_jaccard_join": chosen_path.op8_ngram_jaccard_join,
        "op9_url_filter": url_filter.op9_url_filter,
        "op10_line_dedup": line_dedup.op10_line_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mix_sources": mixing.ORACLE,
        "op4_exact_topk": topk.ORACLE,
        "op7_tool_chat": tool_chat.ORACLE,
        "op8_ngram_jaccard_join": chosen_path.ORACLE,
        "op9_url_filter": url_filter.ORACLE,
        "op10_line_dedup": line_dedup.ORACLE,
    }
