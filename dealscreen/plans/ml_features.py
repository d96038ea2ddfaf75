"""Feature table: one row per listing (its latest version) in a single pass over bronze.

Listing attributes are the silver ones and metrics the screen's, so both
tables can only change together; what differs is the loan, which is the
*price* times the target LTV here, and the value, which is the listing's own
estimate. The parcel's triangulation contributes its confidence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dealscreen.config import Assumptions
from dealscreen.functions import deal_math as dm
from dealscreen.operators.dedup import dedup_latest
from dealscreen.operators.screen import join_values, underwriting
from dealscreen.plans.silver import listing_attributes
from dealscreen.schemas import BRONZE_SCHEMA, LISTING_ORDER, ML_ALL_COLS, ML_TARGET_COL, conform

# Feature names of bronze columns beyond the silver ones, and columns taken over as they are.
FEATURE_COLUMNS = {"beds": "BedroomsTotal", "baths": "BathroomsTotal", "sqft": "LivingArea"}
TAKEN_OVER = ("source", "search_url", "value_estimate")


def ml_features(bronze: DataFrame, values: DataFrame, a: Assumptions | None = None,
                order: tuple[str, ...] = tuple(LISTING_ORDER)) -> DataFrame:
    a = a or Assumptions()
    latest = dedup_latest(conform(bronze, BRONZE_SCHEMA), ["ListingKey"], list(order))
    listing = listing_attributes() | {name: F.col(c) for name, c in FEATURE_COLUMNS.items()}
    listing["monthly_hoa"] = F.coalesce(listing["monthly_hoa"], F.lit(0.0))
    rows = latest.select(*[c.alias(name) for name, c in listing.items()], *TAKEN_OVER)
    rows = join_values(rows, values.select("apn", "value_confidence"), ("value_confidence",))

    price = F.col("list_price")
    made = underwriting(a, F.coalesce(F.col("value_estimate"), price), price)
    made[ML_TARGET_COL] = dm.investment_grade(made["dscr"], made["ltv"], made["instant_equity"], a)
    made["price_per_sqft"] = dm.price_per_sqft(price, "sqft")
    made["tax_rate"] = dm.tax_rate("annual_property_tax", price)
    return rows.select(*[made.get(name, F.col(name)).alias(name) for name in ML_ALL_COLS])
