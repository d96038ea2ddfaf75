"""Rental-deal screening as Spark DataFrame jobs.

Listings and independent value estimates go through a medallion flow:
bronze (raw feeds) -> silver (normalised parcel numbers, latest version per
key) -> gold (blended value, debt-service coverage, equity, rank). Every step
is a pure function ``DataFrame -> DataFrame`` built from native column
expressions, so Catalyst plans it and whole-stage codegen runs it.

Main entry points:

* ``plans.silver.silver_listings`` / ``silver_value_estimates``
* ``operators.triangulate.value_triangulation`` (exact or approximate median)
* ``plans.gold.gold_deal_screen`` (screen + distributed rank)
* ``plans.ml_features.ml_features``
* ``operators.rank.rank`` / ``rank_deals`` / ``top_k_deals``
* ``operators.serve.top_deals`` / ``deal_by_apn``
* ``sources.portal.search`` / ``map_portal``, ``sources.files.read_bronze`` /
  ``write_landing``, ``sources.incremental.incremental_pull``
* ``streaming.bronze.run_bronze``, ``plans.pipeline.run_pipeline`` /
  ``run_from_landing``
"""

from dealscreen.config import Assumptions, Namespace

__all__ = ["Assumptions", "Namespace"]
