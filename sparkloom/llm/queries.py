"""The registered queries of this package and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import brown, chat, fingerprint, langid, mixing, neardup, packing, tokencount, tokenfile, topk


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": neardup.op1_near_duplicates,
        "op2_exact_topk": topk.op2_exact_topk,
        "op3_fingerprints": fingerprint.op3_fingerprints,
        "op4_class_lm": brown.op4_class_lm,
        "op5_token_counts": tokencount.op5_token_counts,
        "op6_chat_format": chat.op6_chat_format,
        "op7_mixing": mixing.op7_mixing,
        "op8_token_files": tokenfile.op8_token_files,
        "op9_packing": packing.op9_packing,
        "op10_language_id": langid.op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_topk": topk.OP2_SQL,
        "op6_chat_format": chat.OP6_SQL,
        "op7_mixing": mixing.OP7_SQL,
    }
