"""Per-listing deal screen: value, rent, PITIA, DSCR, LTV, equity, pass flag.

The loan is the blended *value* times the target LTV; all outputs are
rounded (money 2, DSCR 3, LTV 4) and the pass test is applied to the rounded
DSCR and LTV. A missing HOA is no HOA; a missing tax leaves PITIA and DSCR
unknown and the listing does not pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscreen.config import Assumptions
from dealscreen.functions import deal_math as dm


# A parcel-less listing joins on a key no parcel can have (parcel keys never
# contain NUL), made unique by its listing key.
_NO_PARCEL = "\u0000"


def join_values(listings: DataFrame, values: DataFrame,
                columns: tuple[str, ...] = ("value_estimate", "value_confidence")) -> DataFrame:
    """Left join listings to one triangulated value row per parcel.

    Listings without a parcel number can never match; instead of all hashing
    to one reducer under a null key, each gets its own never-matching key, so
    they spread over the cluster in the same single pass. A hot parcel on the
    listing side is split by AQE's skew-join handling (the value side holds one
    row per parcel); AQE also turns the join into a broadcast when the value
    side is measured small at run time.
    """
    vals = values.select(F.col("apn").alias("_vk"), *columns)
    key = F.coalesce(F.col("apn"), F.concat(F.lit(_NO_PARCEL), F.col("listing_key")))
    left = listings.withColumn("_jk", key)
    return left.join(vals, left["_jk"] == vals["_vk"], "left").drop("_jk", "_vk")


def underwriting(a: Assumptions, value: Column, loan_base: Column) -> dict[str, Column]:
    """Rounded metrics by name of rows with list_price, annual_property_tax and monthly_hoa.

    ``value`` is what equity and loan-to-value are measured against; the loan
    is ``loan_base`` times the target LTV (the screen lends on the value, the
    feature table on the price).
    """
    price = F.col("list_price")
    loan, closing = loan_base * F.lit(float(a.ltv_target)), price * F.lit(float(a.closing_pct))
    rent = dm.est_monthly_rent(price, a.rent_to_price_monthly)
    interest = dm.monthly_payment(loan, a.annual_rate, a.term_years)
    cost = dm.pitia(interest, F.col("annual_property_tax"), a.annual_insurance, F.col("monthly_hoa"))
    return {
        "dscr": F.round(dm.dscr(rent, cost), dm.DSCR_DIGITS),
        "ltv": F.round(dm.ltv(loan, value), dm.RATIO_DIGITS),
        **{name: dm.money(c) for name, c in {
            "est_monthly_rent": rent, "monthly_pi": interest, "monthly_pitia": cost,
            "instant_equity": dm.instant_equity(value, price),
            "equity_after_close": dm.equity_after_close(value, price, closing)}.items()},
    }


def screen_columns(df: DataFrame, a: Assumptions) -> DataFrame:
    """Add the screen columns to rows holding list_price, annual_property_tax,
    monthly_hoa, value_estimate (nullable)."""
    value = F.coalesce(F.col("value_estimate"), F.col("list_price"))
    metrics = underwriting(a, value, value)
    ltv_cap = float(a.ltv_target) + 0.001
    passes = (dm.dscr_passes(metrics["dscr"], a.dscr_threshold)
              & F.coalesce(metrics["ltv"] <= F.lit(ltv_cap), F.lit(False)))
    return df.select(
        "*", dm.money(value).alias("value"), passes.alias("passes"),
        *[c.alias(name) for name, c in metrics.items() if name in SCREEN_COLS],
        F.coalesce(F.col("monthly_hoa"), F.lit(0.0)).alias("_hoa0"),
    ).drop("monthly_hoa").withColumnRenamed("_hoa0", "monthly_hoa")


SCREEN_COLS = [
    "apn", "listing_key", "address", "postal_code", "property_type", "value", "value_confidence",
    "est_monthly_rent", "monthly_pitia", "dscr", "ltv", "instant_equity", "equity_after_close",
    "has_hoa", "monthly_hoa", "passes",
]


def deal_screen(listings: DataFrame, values: DataFrame, a: Assumptions | None = None) -> DataFrame:
    """silver listings + triangulated values -> screen rows (without rank)."""
    a = a or Assumptions()
    return screen_columns(join_values(listings, values), a).select(*SCREEN_COLS)
