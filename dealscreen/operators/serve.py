"""Serving queries over the ranked table: filtered top-k and point lookup.

Filters are typed literals (no SQL text is built from request values), so
they are pushed into the parquet scan; ``orderBy().limit(k)`` plans as a
``TakeOrderedAndProject`` that keeps only k rows per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscreen.config import Namespace

# Fixed value: default number of deals served.
DEFAULT_LIMIT = 50


def top_deals(ranked: DataFrame, k: int = DEFAULT_LIMIT, min_dscr: float | None = None,
              passes_only: bool = False) -> DataFrame:
    df = ranked
    if passes_only:
        df = df.filter(F.col("passes") == F.lit(True))
    if min_dscr is not None:
        df = df.filter(F.col("dscr") >= F.lit(float(min_dscr)))
    return df.orderBy(F.col("rank_score").asc_nulls_last()).limit(int(k))


def deal_by_apn(ranked: DataFrame, apn: str) -> DataFrame:
    """The best-ranked row of one parcel; empty if the parcel is absent."""
    return ranked.filter(F.col("apn") == F.lit(str(apn))).orderBy(F.col("rank_score").asc_nulls_last()).limit(1)


def serving_table(spark: SparkSession, ns: Namespace) -> DataFrame:
    """The ranked table if it exists, else the gold screen."""
    ranked = ns.licensed("gold_ranked")
    if spark.catalog.tableExists(ranked):
        return spark.read.table(ranked)
    return spark.read.table(ns.licensed("gold_deal_screen"))
