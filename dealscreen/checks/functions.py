"""Checks of the column functions, applied to every listing of the adapter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscreen import oracle_sql as osql
from dealscreen.checks import register
from dealscreen.checks.core import bronze, estimates, listings
from dealscreen.config import Assumptions
from dealscreen.functions import deal_math as dm
from dealscreen.functions import text as tx
from dealscreen.operators.triangulate import value_triangulation

A = Assumptions()
d = osql.d
rnd = osql.rnd
BASE = osql.with_base(osql.silver_listings_cte())
TRI = osql.with_base(osql.silver_listings_cte(), osql.silver_estimates_cte(), osql.triangulation_cte())


def _loan_rows(spark: SparkSession, sf: str) -> DataFrame:
    return listings(spark, sf).select("listing_key", "list_price", "annual_property_tax", "monthly_hoa",
                                      (F.col("list_price") * F.lit(0.75)).alias("loan"))


LOAN_SQL = (f"SELECT listing_key, list_price, annual_property_tax, monthly_hoa, list_price * {d(0.75)} AS loan "
            "FROM silver_listings")

# Payment under three loan terms, plus a loan that is <= 0 for cheap listings.
register("mortgage_payment", BASE + f"""
SELECT listing_key, loan,
  {osql.payment_sql('loan', A, 0.075, 30)} AS pay_30y,
  {osql.payment_sql('loan', A, 0.06, 15)} AS pay_15y,
  {osql.payment_sql('loan', A, 0.0, 30)} AS pay_zero_rate,
  {osql.payment_sql(f'(loan - {d(150000.0)})', A, 0.075, 30)} AS pay_small_loan
FROM ({LOAN_SQL}) x""")(
    lambda spark, sf: _loan_rows(spark, sf).select(
        "listing_key", "loan",
        dm.monthly_payment("loan", 0.075, 30).alias("pay_30y"),
        dm.monthly_payment("loan", 0.06, 15).alias("pay_15y"),
        dm.monthly_payment("loan", 0.0, 30).alias("pay_zero_rate"),
        dm.monthly_payment(F.col("loan") - F.lit(150000.0), 0.075, 30).alias("pay_small_loan"),
    ))

_PITIA_SQL = (f"{osql.payment_sql('loan', A, 0.075, 30)} + annual_property_tax / {d(12.0)} + {d(1800.0 / 12.0)}"
              f" + coalesce(monthly_hoa, {d(0.0)})")
_RENT_SQL = f"list_price * {d(0.008)}"


def _pitia_rows(spark: SparkSession, sf: str) -> DataFrame:
    r = _loan_rows(spark, sf)
    return r.select(
        "listing_key",
        (F.col("list_price") * F.lit(0.008)).alias("rent"),
        dm.pitia(dm.monthly_payment("loan", 0.075, 30), F.col("annual_property_tax"), 1800.0,
                 F.col("monthly_hoa")).alias("pitia"),
    )


register("pitia", BASE + f"\nSELECT listing_key, {_PITIA_SQL} AS pitia FROM ({LOAN_SQL}) x")(
    lambda spark, sf: _pitia_rows(spark, sf).select("listing_key", "pitia"))

register("dscr_gross", BASE + f"""
SELECT listing_key, CASE WHEN p > 0 THEN rent / p END AS dscr,
  coalesce(CASE WHEN p > 0 THEN rent / p END >= {d(1.2)}, false) AS passes
FROM (SELECT listing_key, {_RENT_SQL} AS rent, {_PITIA_SQL} AS p FROM ({LOAN_SQL}) x) y""")(
    lambda spark, sf: _pitia_rows(spark, sf).select(
        "listing_key", dm.dscr("rent", "pitia").alias("dscr"),
        dm.dscr_passes(dm.dscr("rent", "pitia"), 1.2).alias("passes")))

register("dscr_noi", BASE + f"""
SELECT listing_key, CASE WHEN p > 0 THEN rent * {d(1.0 - 0.25)} / p END AS dscr_noi
FROM (SELECT listing_key, {_RENT_SQL} AS rent, {_PITIA_SQL} AS p FROM ({LOAN_SQL}) x) y""")(
    lambda spark, sf: _pitia_rows(spark, sf).select(
        "listing_key", dm.dscr("rent", "pitia", 0.25, use_noi=True).alias("dscr_noi")))


def _valued(spark: SparkSession, sf: str) -> DataFrame:
    from dealscreen.operators.screen import join_values

    j = join_values(listings(spark, sf), value_triangulation(estimates(spark, sf)))
    return j.select("listing_key", "list_price",
                    F.coalesce(F.col("value_estimate"), F.col("list_price")).alias("v"))


VALUED_SQL = ("SELECT l.listing_key, l.list_price, coalesce(t.value_estimate, l.list_price) AS v "
              "FROM silver_listings l LEFT JOIN tri t ON l.apn = t.apn")

register("equity", TRI + f"""
SELECT listing_key, v - list_price AS instant_equity,
  v - (list_price + list_price * {d(0.03)} + {d(0.0)}) AS equity_after_close,
  v - (list_price + list_price * {d(0.03)} + {d(5000.0)}) AS equity_after_rehab
FROM ({VALUED_SQL}) x""")(
    lambda spark, sf: _valued(spark, sf).select(
        "listing_key",
        dm.instant_equity("v", "list_price").alias("instant_equity"),
        dm.equity_after_close("v", "list_price", F.col("list_price") * F.lit(0.03)).alias("equity_after_close"),
        dm.equity_after_close("v", "list_price", F.col("list_price") * F.lit(0.03),
                              F.lit(5000.0)).alias("equity_after_rehab"),
    ))

register("ltv", TRI + f"""
SELECT listing_key,
  CASE WHEN v > 0 THEN (list_price * {d(0.75)}) / v END AS ltv,
  CASE WHEN (v - {d(200000.0)}) > 0 THEN (list_price * {d(0.75)}) / (v - {d(200000.0)}) END AS ltv_shifted
FROM ({VALUED_SQL}) x""")(
    lambda spark, sf: _valued(spark, sf).select(
        "listing_key",
        dm.ltv(F.col("list_price") * F.lit(0.75), "v").alias("ltv"),
        dm.ltv(F.col("list_price") * F.lit(0.75), F.col("v") - F.lit(200000.0)).alias("ltv_shifted"),
    ))

# Bands with the default and with tighter custom thresholds.
register("confidence_band", osql.with_base(osql.silver_estimates_cte(), osql.triangulation_cte()) + f"""
SELECT apn, n_sources, spread_pct, value_confidence,
  CASE WHEN n_sources IS NULL THEN NULL WHEN n_sources < 2 THEN 'low' WHEN spread_pct <= {d(0.02)} THEN 'high'
       WHEN spread_pct <= {d(0.08)} THEN 'medium' ELSE 'low' END AS tight_confidence
FROM tri""")(
    lambda spark, sf: value_triangulation(estimates(spark, sf)).select(
        "apn", "n_sources", "spread_pct", "value_confidence",
        dm.confidence_band("n_sources", "spread_pct", 0.02, 0.08).alias("tight_confidence")))


# Full explicit-input screen: each listing with its parcel's estimates as an array.
def _screen_property(spark: SparkSession, sf: str) -> DataFrame:
    est = estimates(spark, sf).groupBy("apn").agg(F.collect_list("value_estimate").alias("estimates"))
    from dealscreen.operators.screen import join_values

    j = join_values(listings(spark, sf), est, ("estimates",))
    p = F.col("list_price")
    s = dm.screen_property(
        monthly_rent=p * F.lit(0.008), purchase_price=p, loan_amount=p * F.lit(0.75),
        annual_property_tax=F.col("annual_property_tax"), value_estimates=F.col("estimates"),
        monthly_hoa=F.col("monthly_hoa"), closing_costs=p * F.lit(0.03), rehab_costs=F.lit(2500.0),
    )
    return j.select("listing_key", s.alias("s")).select("listing_key", "s.*")


register("screen_property", osql.with_base(osql.silver_listings_cte(), osql.silver_estimates_cte()) + f"""
, agg AS (
  SELECT apn, median(value_estimate) AS med, min(value_estimate) AS mn, max(value_estimate) AS mx, count(*) AS n
  FROM silver_value_estimates WHERE value_estimate > 0 GROUP BY apn
), x AS (
  SELECT l.listing_key, l.list_price AS p, l.annual_property_tax AS tax, l.monthly_hoa AS hoa,
    l.list_price * {d(0.75)} AS loan, l.list_price * {d(0.008)} AS rent, l.list_price * {d(0.03)} AS closing,
    CASE WHEN a.n > 0 THEN {rnd('a.med', 2)} ELSE l.list_price END AS v,
    CASE WHEN a.n > 0 THEN CASE WHEN a.n < 2 THEN 'low'
      WHEN (CASE WHEN a.med <> 0 THEN (a.mx - a.mn) / a.med ELSE {d(1.0)} END) <= {d(0.05)} THEN 'high'
      WHEN (CASE WHEN a.med <> 0 THEN (a.mx - a.mn) / a.med ELSE {d(1.0)} END) <= {d(0.12)} THEN 'medium'
      ELSE 'low' END END AS conf
  FROM silver_listings l LEFT JOIN agg a ON l.apn = a.apn
), y AS (
  SELECT *, {osql.payment_sql('loan', A, 0.075, 30)} + tax / {d(12.0)} + {d(1800.0 / 12.0)}
    + coalesce(hoa, {d(0.0)}) AS pit FROM x
)
SELECT listing_key, CASE WHEN pit > 0 THEN rent / pit END AS dscr, {rnd('pit', 2)} AS monthly_pitia,
  {rnd('v - p', 2)} AS instant_equity, {rnd(f'v - (p + closing + coalesce({d(2500.0)}, {d(0.0)}))', 2)} AS equity_after_close,
  {rnd('CASE WHEN v > 0 THEN loan / v END', 4)} AS ltv, v AS value_estimate, conf AS value_confidence,
  coalesce(CASE WHEN pit > 0 THEN rent / pit END >= {d(1.2)}, false)
    AND coalesce(CASE WHEN v > 0 THEN loan / v END <= {d(0.8)}, false) AS passes
FROM y""")(_screen_property)

# --------------------------------------------------------------------------- #
# Text functions
# --------------------------------------------------------------------------- #
_TEXT_SQL = """SELECT seq,
  '$' || CAST(CAST(ListPrice AS BIGINT) AS VARCHAR) AS t_price,
  concat(CAST(BedroomsTotal AS VARCHAR), ' beds, ', CAST(CAST(LivingArea AS BIGINT) AS VARCHAR), ' sq.ft') AS t_area,
  concat(PostalCode, '.', CAST(seq % 7 AS VARCHAR), '.5') AS t_bad,
  CASE WHEN seq % 3 = 0 THEN ' n/a ' ELSE concat(CAST(seq AS VARCHAR), ',', CAST(seq % 1000 AS VARCHAR)) END AS t_mixed
FROM fx_bronze"""
_NUM_SQL = "CASE WHEN regexp_replace({c}, '[^0-9.]', '', 'g') <> '' THEN TRY_CAST(regexp_replace({c}, '[^0-9.]', '', 'g') AS DOUBLE) END"

register("number_from_text", osql.with_base() + f"""
SELECT seq, t_price, {_NUM_SQL.format(c='t_price')} AS price, {_NUM_SQL.format(c='t_area')} AS area,
  {_NUM_SQL.format(c='t_bad')} AS bad, {_NUM_SQL.format(c='t_mixed')} AS mixed
FROM ({_TEXT_SQL}) x""")(
    lambda spark, sf: bronze(spark, sf).selectExpr(
        "seq",
        "concat('$', CAST(CAST(ListPrice AS BIGINT) AS STRING)) AS t_price",
        "concat(CAST(BedroomsTotal AS STRING), ' beds, ', CAST(CAST(LivingArea AS BIGINT) AS STRING), ' sq.ft') AS t_area",
        "concat(PostalCode, '.', CAST(seq % 7 AS STRING), '.5') AS t_bad",
        "CASE WHEN seq % 3 = 0 THEN ' n/a ' ELSE concat(CAST(seq AS STRING), ',', CAST(seq % 1000 AS STRING)) END AS t_mixed",
    ).select("seq", "t_price", tx.number_from_text("t_price").alias("price"),
             tx.number_from_text("t_area").alias("area"), tx.number_from_text("t_bad").alias("bad"),
             tx.number_from_text("t_mixed").alias("mixed")))

register("apn_normalize", osql.with_base() + f"""
SELECT seq, ParcelNumber AS raw, {osql.APN_RAW_SQL.format(c='ParcelNumber')} AS apn,
  {osql.APN_RAW_SQL.format(c="chr(9) || lower(ParcelNumber) || ' -' || chr(10)")} AS apn_ws,
  {osql.apn('ParcelNumber')} AS apn_key
FROM fx_bronze""")(
    lambda spark, sf: bronze(spark, sf).select(
        "seq", F.col("ParcelNumber").alias("raw"), tx.normalize_apn("ParcelNumber").alias("apn"),
        tx.normalize_apn(F.expr("concat(chr(9), lower(ParcelNumber), ' -', chr(10))")).alias("apn_ws"),
        tx.apn_key("ParcelNumber").alias("apn_key")))

register("batch_label", osql.with_base() + """
SELECT seq, strftime(ModificationTimestamp, '%Y%m%d_%H%M%S') AS pull_label,
  strftime(ModificationTimestamp, '%Y%m%dT%H%M%S') AS portal_label,
  strftime(ModificationTimestamp, '%Y-%m-%dT%H:%M:%SZ') AS iso_utc
FROM fx_bronze""")(
    lambda spark, sf: bronze(spark, sf).select(
        "seq", tx.batch_label("ModificationTimestamp").alias("pull_label"),
        tx.batch_label("ModificationTimestamp", tx.PORTAL_LABEL_FORMAT).alias("portal_label"),
        tx.iso_utc("ModificationTimestamp").alias("iso_utc")))
