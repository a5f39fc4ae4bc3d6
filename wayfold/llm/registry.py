"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, exact_dedup, fingerprint, minhash, mixing, packing, pii, quality, substring, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_quality": quality.op3_quality,
        "op4_fingerprint": fingerprint.op4_fingerprint,
        "op5_mix_sources": mixing.op5_mix_sources,
        "op6_pack": packing.op6_pack,
        "op7_pii": pii.op7_pii,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_suffix_dedup": substring.op9_suffix_dedup,
        "op10_chat_format": chat.op10_chat_format,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": minhash.OP1_SQL,
        "op2_exact_dedup": exact_dedup.OP2_SQL,
        "op5_mix_sources": mixing.OP5_SQL,
        "op9_suffix_dedup": substring.OP9_SQL,
        "op10_chat_format": chat.OP10_SQL,
    }
