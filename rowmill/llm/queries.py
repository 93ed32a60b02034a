"""The queries of this package, with oracle SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowmill.llm import bpe, chat, exact_dedup, licences, mixing, ngram_join, sharding, toxicity, transport, url_filter

_MODULES = {
    "op1_exact_dedup": exact_dedup,
    "op2_toxicity": toxicity,
    "op3_chat_format": chat,
    "op4_byte_bpe": bpe,
    "op5_kd_shards": sharding,
    "op6_transport_stream": transport,
    "op7_url_filter": url_filter,
    "op8_ngram_join": ngram_join,
    "op9_licence_scan": licences,
    "op10_source_mix": mixing,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.ORACLE for name, module in _MODULES.items() if hasattr(module, "ORACLE")}
