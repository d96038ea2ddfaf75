"""Silver layer: clean, parcel-keyed listings and value estimates.

The parcel number is normalised with native string functions (no Python
UDF, so the key stays inside codegen); blank keys become null so they never
join each other. Each listing keeps its latest version, each (parcel,
source) its latest estimate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscreen.functions.text import apn_key
from dealscreen.operators.dedup import dedup_latest, null_key_rows, with_order
from dealscreen.schemas import (ESTIMATE_ORDER, LISTING_ORDER, SILVER_LISTINGS_COLS,
                                SILVER_VALUE_ESTIMATES_COLS)


# Silver names of bronze columns.
LISTING_TEXTS = {"listing_key": "ListingKey", "address": "UnparsedAddress", "postal_code": "PostalCode",
                 "property_type": "PropertyType"}
LISTING_NUMBERS = {"list_price": "ListPrice", "annual_property_tax": "TaxAnnualAmount", "monthly_hoa": "MonthlyHOAAmt"}


def listing_attributes() -> dict[str, Column]:
    """The silver columns of a listing as expressions over bronze columns."""
    hoa = F.col("MonthlyHOAAmt")
    return {
        "apn": apn_key("ParcelNumber"),
        **{name: F.col(c) for name, c in LISTING_TEXTS.items()},
        **{name: F.col(c).cast("double") for name, c in LISTING_NUMBERS.items()},
        "has_hoa": F.coalesce(hoa > 0, F.lit(False)),
    }


def silver_listings(bronze: DataFrame, order: Sequence[str] = tuple(LISTING_ORDER)) -> DataFrame:
    """bronze listing versions -> one row per ``listing_key`` (9 columns)."""
    renamed = bronze.select(
        *[c.alias(name) for name, c in listing_attributes().items()],
        *with_order(bronze, order),
    )
    ties = [c for c in SILVER_LISTINGS_COLS if c != "listing_key"]
    return dedup_latest(renamed, ["listing_key"], [*order, *ties]).select(*SILVER_LISTINGS_COLS)


def quarantined_listings(bronze: DataFrame) -> DataFrame:
    """Listing rows without a key: kept aside, never deduplicated together."""
    return null_key_rows(bronze.withColumnRenamed("ListingKey", "listing_key"), ["listing_key"])


def silver_value_estimates(feeds: Sequence[DataFrame], order: Sequence[str] = tuple(ESTIMATE_ORDER)) -> DataFrame:
    """Union of estimate feeds -> latest estimate per (apn, estimate_source).

    Each feed holds ParcelNumber, value_estimate, estimate_source and, where
    it has them, the ``order`` columns; what ties on these is decided by the
    value. Rows without a parcel, value or source are set aside
    (``quarantined_estimates``).
    """
    return dedup_latest(estimate_rows(feeds, order), ["apn", "estimate_source"], [*order, "value_estimate"]).select(*SILVER_VALUE_ESTIMATES_COLS)


def estimate_rows(feeds: Sequence[DataFrame], order: Sequence[str] = tuple(ESTIMATE_ORDER)) -> DataFrame:
    """All estimates of all feeds that have a parcel and a value, with the ``order`` columns."""
    # A feed without an order column has nulls of the type that it has in the others.
    types = {c: f.schema[c].dataType for f in feeds for c in order if c in f.columns}
    parts = [
        f.select(
            apn_key("ParcelNumber").alias("apn"),
            F.col("value_estimate").cast("double").alias("value_estimate"),
            F.col("estimate_source").cast("string").alias("estimate_source"),
            *[(F.col(c) if c in f.columns else F.lit(None).cast(types.get(c, "string"))).alias(c) for c in order],
        )
        for f in feeds
    ]
    unioned = parts[0]
    for p in parts[1:]:
        unioned = unioned.unionByName(p)
    return unioned.filter(F.col("apn").isNotNull() & F.col("value_estimate").isNotNull())


def quarantined_estimates(feeds: Sequence[DataFrame]) -> DataFrame:
    """Estimate rows that lack a parcel, a value or a source, as they came."""
    cols = ["ParcelNumber", "value_estimate", "estimate_source"]
    parts = [f.select(F.col(cols[0]).cast("string"), F.col(cols[1]).cast("double"), F.col(cols[2]).cast("string")) for f in feeds]
    unioned = parts[0]
    for p in parts[1:]:
        unioned = unioned.unionByName(p)
    return unioned.filter(apn_key(cols[0]).isNull() | F.col(cols[1]).isNull() | F.col(cols[2]).isNull())


def mls_list_estimates(bronze: DataFrame, order: Sequence[str] = tuple(LISTING_ORDER)) -> DataFrame:
    """The listings' own prices as an estimate feed (source ``mls_list``), one per listing version."""
    return bronze.select("ParcelNumber", F.col("ListPrice").cast("double").alias("value_estimate"),
                         F.lit("mls_list").alias("estimate_source"),
                         F.col("ModificationTimestamp").alias("as_of") if "ModificationTimestamp" in bronze.columns
                         else F.lit(None).cast("timestamp_ntz").alias("as_of"),
                         *[F.col(c) for c in ("seq",) if c in bronze.columns])


def own_estimates(bronze: DataFrame) -> DataFrame:
    """Estimates that listing rows carry themselves (portal feeds), with their own source label."""
    return bronze.where(F.col("value_estimate").isNotNull()).select(
        "ParcelNumber", F.col("value_estimate").cast("double").alias("value_estimate"), "estimate_source",
        *[F.col(c).alias("as_of") for c in ("ModificationTimestamp",) if c in bronze.columns],
        *[F.col(c) for c in ("seq",) if c in bronze.columns])
