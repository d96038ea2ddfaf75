"""Blend independent value estimates per parcel into one value + confidence.

Only positive estimates count; a parcel with none has no triangulation row.
``method="exact"`` averages the two middle values (the canonical library
median); ``method="approx"`` is ``percentile_approx``, which returns the
lower middle element for small groups.

Scale: the aggregate is hash-partitioned on ``apn`` after a map-side partial
aggregate; ``count_distinct`` adds a (apn, source) pre-aggregation, so even a
parcel holding a large share of all estimate rows arrives at its reducer as
at most one partial row per map task and source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealscreen.config import Assumptions
from dealscreen.functions.deal_math import MONEY_DIGITS, RATIO_DIGITS, confidence_band, spread


def value_triangulation(estimates: DataFrame, method: str = "exact", a: Assumptions | None = None) -> DataFrame:
    """``(apn, value_estimate, estimate_source)`` -> one row per parcel.

    Output: apn, value_estimate (rounded to cents), n_sources (bigint),
    spread_pct (rounded to 4), value_confidence (high / medium / low, tested
    on the unrounded spread).
    """
    a = a or Assumptions()
    if method == "exact":
        med = F.median("value_estimate")
    elif method == "approx":
        med = F.percentile_approx("value_estimate", 0.5)
    else:
        raise ValueError(f"method must be 'exact' or 'approx', not {method!r}")
    agg = (
        estimates.filter(F.col("apn").isNotNull() & (F.col("value_estimate") > 0))
        .groupBy("apn")
        .agg(
            med.alias("_med"),
            F.min("value_estimate").alias("_min"),
            F.max("value_estimate").alias("_max"),
            F.count_distinct("estimate_source").cast("bigint").alias("n_sources"),
        )
    )
    s = spread("_max", "_min", "_med")
    return agg.select(
        "apn",
        F.round("_med", MONEY_DIGITS).alias("value_estimate"),
        "n_sources",
        F.round(s, RATIO_DIGITS).alias("spread_pct"),
        confidence_band("n_sources", s, a.high_spread, a.medium_spread).alias("value_confidence"),
    )


triangulate = value_triangulation
