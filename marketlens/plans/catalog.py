"""Registered questions: one Spark plan and one oracle statement per operator id.

entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame over the whole
driver tables; each oracle entry is DuckDB SQL over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register questions."""
    import importlib
    for name in MODULES:
        importlib.import_module(f"marketlens.plans.{name}")


MODULES = ["q_price", "q_clean", "q_features", "q_market", "q_quality", "q_profile",
           "q_ranking", "q_joins", "q_ml", "q_sources"]
