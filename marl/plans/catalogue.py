"""The queries of the engine by name, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marl.plans import formats, graphs, itemsets, recommender, relational, similarity, streams

_MODULES = (relational, itemsets, similarity, recommender, graphs, streams, formats)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
