"""Registered checks: one Spark query per operator and its SQL oracle.

``QUERIES[name](spark, sf_dir) -> DataFrame`` runs the operator over the
whole provided tables (through the fixture adapter); ``ORACLES[name]`` is the
same result written independently in SQL for DuckDB. Queries without an
oracle are checked by row count only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate check {name!r}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco
