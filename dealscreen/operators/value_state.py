"""Triangulation state that merges: one KLL sketch per parcel with count, smallest, largest and the set of sources.

States of different landings merge to the state of all their rows, so a new landing reads its own rows and the state
tables, never the estimates before. Count, extremes and sources are exact. The median comes from the sketch: exact up
to ``K`` estimates a parcel, beyond that within ``RANK_ERROR`` of the middle rank. Every estimate counts (a state can't take a
superseded one back); ``value_triangulation`` stays the operator for the latest estimate of each source.

Scale: partial sketches are merged on the map side, so a parcel with a third of all estimates reaches its reducer as one
sketch of bounded size a task. The set of sources is as large as the number of feeds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealscreen.config import Assumptions
from dealscreen.functions.deal_math import MONEY_DIGITS, RATIO_DIGITS, confidence_band, spread

#: Size parameter of the sketches, and the rank error that it keeps with high probability (normalised, as a share of n).
K, RANK_ERROR = 400, 0.01


def value_state(estimates: DataFrame, k: int = K) -> DataFrame:
    """apn, sketch, n, low, high, sources of estimates (apn, value_estimate, estimate_source)."""
    rows = estimates.where(F.col("apn").isNotNull() & (F.col("value_estimate") > 0))
    return rows.groupBy("apn").agg(
        F.kll_sketch_agg_double("value_estimate", F.lit(k)).alias("sketch"), F.count(F.lit(1)).alias("n"),
        F.min("value_estimate").alias("low"), F.max("value_estimate").alias("high"),
        F.sort_array(F.collect_set("estimate_source")).alias("sources"))


def merge_states(*states: DataFrame, k: int = K) -> DataFrame:
    """One state per parcel of all given ones."""
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return every.groupBy("apn").agg(
        F.kll_merge_agg_double("sketch", F.lit(k)).alias("sketch"), F.sum("n").alias("n"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.sort_array(F.array_distinct(F.flatten(F.collect_set("sources")))).alias("sources"))


def state_values(state: DataFrame, a: Assumptions | None = None) -> DataFrame:
    """The triangulated value of each parcel's state, in the columns of ``value_triangulation``, and the number of estimates."""
    a = a or Assumptions()
    rows = state.withColumn("_mid", F.kll_sketch_get_quantile_double("sketch", F.lit(0.5))).withColumn(
        "n_sources", F.size("sources").cast("long"))
    s = spread("high", "low", "_mid")
    return rows.select("apn", F.round("_mid", MONEY_DIGITS).alias("value_estimate"), "n_sources", F.round(s, RATIO_DIGITS).alias("spread_pct"),
                       confidence_band("n_sources", s, a.high_spread, a.medium_spread).alias("value_confidence"), "n")
