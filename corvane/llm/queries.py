"""Queries of the preparation operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import chat, chosen_path, decontamination, html_diff, langid, metric_join, mixing, quality, revisit, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_decontaminate": decontamination.op2_decontaminate,
        "op3_mixing": mixing.op3_mixing,
        "op4_quality": quality.op4_quality,
        "op5_html_differencing": html_diff.op5_html_differencing,
        "op6_language_id": langid.op6_language_id,
        "op7_chat_snapshots": chat.op7_chat_snapshots,
        "op8_revisit_resolution": revisit.op8_revisit_resolution,
        "op9_embedding_range_join": metric_join.op9_embedding_range_join,
        "op10_minhash_chosen_path": chosen_path.op10_minhash_chosen_path,
    }


def oracle_sql() -> dict[str, str]:
    """Operators 1, 4, 5, 6 and 10 have no SQL: two networks, a filter, an alignment and an approximate join."""
    return {
        "op2_decontaminate": decontamination.ORACLE,
        "op3_mixing": mixing.ORACLE,
        "op7_chat_snapshots": chat.ORACLE,
        "op8_revisit_resolution": revisit.ORACLE,
        "op9_embedding_range_join": metric_join.ORACLE,
    }
