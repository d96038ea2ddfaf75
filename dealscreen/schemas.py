"""Table contracts: explicit schemas per layer and a checker.

Bronze is read with an explicit schema per feed (JSON field names are matched
case-sensitively, and an all-null field would otherwise infer as string).
Silver and gold are fixed by projection; the column lists below are their
contracts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()


def _struct(*pairs) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in pairs])


# RESO-style licensed feed (PascalCase), as landed by incremental pulls.
BRONZE_FIELDS = [
    ("ParcelNumber", S), ("ListingKey", S), ("UnparsedAddress", S), ("PostalCode", S),
    ("PropertyType", S), ("ListPrice", D), ("TaxAnnualAmount", D), ("MonthlyHOAAmt", D),
    ("BedroomsTotal", I), ("BathroomsTotal", D), ("LivingArea", D), ("City", S), ("State", S),
    ("source", S), ("search_url", S), ("value_estimate", D), ("estimate_source", S),
    ("ModificationTimestamp", T.TimestampNTZType()), ("seq", L),
]
BRONZE_SCHEMA = _struct(*BRONZE_FIELDS)
CORRUPT_COL = "_corrupt_record"
BRONZE_READ_SCHEMA = _struct(*BRONZE_FIELDS, (CORRUPT_COL, S))

# Portal feed rows: lower-case record fields plus the bronze (PascalCase) keys.
PORTAL_RECORD_FIELDS = [
    ("source", S), ("listing_key", S), ("address", S), ("city", S), ("state", S),
    ("postal_code", S), ("list_price", D), ("property_type", S), ("beds", I), ("baths", D),
    ("sqft", D), ("lot_sqft", D), ("year_built", I), ("url", S), ("annual_property_tax", D),
    ("monthly_hoa", D), ("has_hoa", B), ("apn", S), ("value_estimate", D), ("estimate_source", S),
]
PORTAL_BRONZE_KEYS = [
    ("ParcelNumber", S), ("ListingKey", S), ("UnparsedAddress", S), ("PostalCode", S),
    ("PropertyType", S), ("ListPrice", D), ("TaxAnnualAmount", D), ("MonthlyHOAAmt", D),
    ("BedroomsTotal", I), ("BathroomsTotal", D), ("LivingArea", D), ("search_url", S),
]
PORTAL_SCHEMA = _struct(*PORTAL_RECORD_FIELDS, *PORTAL_BRONZE_KEYS)

# Orders of the latest version of a listing and the latest estimate of a source (descending, nulls last). Columns that a
# feed lacks count as null; what then ties is decided by the values, so that the survivor never depends on timing.
LISTING_ORDER = ["ModificationTimestamp", "seq"]
ESTIMATE_ORDER = ["as_of", "seq"]

SILVER_LISTINGS_COLS = [
    "apn", "listing_key", "address", "postal_code", "property_type", "list_price",
    "annual_property_tax", "monthly_hoa", "has_hoa",
]
SILVER_VALUE_ESTIMATES_COLS = ["apn", "value_estimate", "estimate_source"]

ML_FEATURE_COLS = [
    "beds", "baths", "sqft", "list_price", "price_per_sqft", "annual_property_tax", "tax_rate",
    "monthly_hoa", "has_hoa", "property_type", "postal_code",
]
ML_DERIVED_COLS = [
    "est_monthly_rent", "monthly_pi", "monthly_pitia", "dscr", "ltv", "instant_equity",
    "equity_after_close",
]
ML_TARGET_COL = "heuristic_investment_grade"
ML_METADATA_COLS = [
    "apn", "listing_key", "address", "source", "search_url", "value_estimate", "value_confidence",
]
ML_ALL_COLS = ML_FEATURE_COLS + ML_DERIVED_COLS + [ML_TARGET_COL] + ML_METADATA_COLS

GOLD_TRIANGULATION_COLS = ["apn", "value_estimate", "n_sources", "spread_pct", "value_confidence"]
GOLD_DEAL_SCREEN_COLS = [
    "apn", "listing_key", "address", "postal_code", "property_type", "value", "value_confidence",
    "est_monthly_rent", "monthly_pitia", "dscr", "ltv", "instant_equity", "equity_after_close",
    "has_hoa", "monthly_hoa", "passes", "rank_score",
]


# Table contracts: names and types of every layer's columns, and those that are never null.
SILVER_LISTINGS_SCHEMA = _struct(
    ("apn", S), ("listing_key", S), ("address", S), ("postal_code", S), ("property_type", S), ("list_price", D),
    ("annual_property_tax", D), ("monthly_hoa", D), ("has_hoa", B))
SILVER_VALUE_ESTIMATES_SCHEMA = _struct(("apn", S), ("value_estimate", D), ("estimate_source", S))
GOLD_TRIANGULATION_SCHEMA = _struct(("apn", S), ("value_estimate", D), ("n_sources", L), ("spread_pct", D), ("value_confidence", S))
_TEXTS = {"property_type", "postal_code", "apn", "listing_key", "address", "source", "search_url", "value_confidence"}
_OTHERS = {"beds": I, "has_hoa": B, "passes": B, "rank_score": L, ML_TARGET_COL: B}
GOLD_DEAL_SCREEN_SCHEMA = _struct(*[(c, S if c in _TEXTS else _OTHERS.get(c, D)) for c in GOLD_DEAL_SCREEN_COLS])
ML_SCHEMA = _struct(*[(c, S if c in _TEXTS else _OTHERS.get(c, D)) for c in ML_ALL_COLS])
NEVER_NULL = {
    "silver_listings": ("listing_key", "has_hoa"), "silver_value_estimates": ("apn", "value_estimate", "estimate_source"),
    "gold_value_triangulation": ("apn", "value_estimate", "n_sources"), "silver_ml_features": ("listing_key", "has_hoa", "monthly_hoa"),
    "gold_deal_screen": ("listing_key", "has_hoa", "monthly_hoa", "passes", "rank_score"),
}


def enforce(df: DataFrame, table: str, schema: T.StructType) -> DataFrame:
    """``df`` with exactly the contract's columns and types; a null in a column that is never null fails the write.

    The nulls are checked in the rows as they are written, not in a pass of their own.
    """
    assert_schema(df, schema)
    def checked(c: str):
        wrong = F.raise_error(F.lit(f"{table}.{c} is null")).cast(schema[c].dataType)
        return F.when(F.col(c).isNull(), wrong).otherwise(F.col(c)).alias(c)

    return df.select(*[checked(c) if c in NEVER_NULL.get(table, ()) else F.col(c) for c in df.columns])


def assert_schema(df: DataFrame, expected) -> DataFrame:
    """Raise ``ValueError`` unless ``df`` has exactly the expected columns.

    ``expected`` is a list of names (order checked) or a ``StructType``
    (names, order and types checked). Only the schema is inspected.
    """
    if isinstance(expected, T.StructType):
        got = [(f.name, f.dataType) for f in df.schema.fields]
        want = [(f.name, f.dataType) for f in expected.fields]
    else:
        got = list(df.columns)
        want = list(expected)
    if got != want:
        raise ValueError(f"schema mismatch: expected {want}, got {got}")
    return df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project ``df`` onto ``schema``: cast present fields, add absent ones as typed nulls."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name).cast(f.dataType) if f.name in present else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in schema.fields
        ]
    )
