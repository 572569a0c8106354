"""The queries of this subpackage, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marl.llm import bpe, chat, exact_dedup, fingerprint, langid, line_dedup, mixing, near_dup, secrets, warc

_MODULES = (langid, line_dedup, warc, mixing, exact_dedup, bpe, fingerprint, chat, secrets, near_dup)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for module in _MODULES for name, f in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
