"""Gold layer: value triangulation and the ranked deal screen."""

from __future__ import annotations

from pyspark.sql import DataFrame

from dealscreen.config import Assumptions
from dealscreen.operators.rank import rank_deals
from dealscreen.operators.screen import deal_screen
from dealscreen.operators.triangulate import value_triangulation
from dealscreen.schemas import GOLD_DEAL_SCREEN_COLS


def gold_value_triangulation(estimates: DataFrame, method: str = "exact", a: Assumptions | None = None) -> DataFrame:
    return value_triangulation(estimates, method, a)


def gold_deal_screen(listings: DataFrame, values: DataFrame, a: Assumptions | None = None,
                     num_partitions: int | None = None) -> DataFrame:
    """17-column screen, ranked 1..n (passing first, then equity after close)."""
    return rank_deals(deal_screen(listings, values, a), num_partitions).select(*GOLD_DEAL_SCREEN_COLS)
