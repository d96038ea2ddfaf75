"""Independent SQL statements of the same results, for the DuckDB check.

Each builder returns ANSI SQL over the provided tables (``orders``,
``lineitem``, ``pages``, ...). Assumption values are embedded as exact
double literals, so the arithmetic order and constants equal the Spark plan.
"""

from __future__ import annotations

from dealscreen.config import Assumptions
from dealscreen.fixtures import CTES, OWN_ESTIMATE
from dealscreen.functions.deal_math import annuity_terms


def d(x: float) -> str:
    """Exact double literal (round-trips through the shortest repr)."""
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def rnd(expr: str, digits: int) -> str:
    """Spark's ``round``: HALF_UP on the shortest decimal text of the double.

    (DuckDB's own ``round`` of a double works on the binary value, so the two
    engines would disagree on decimal ties such as 2181.575.)
    """
    return f"CAST(round(CAST(CAST(({expr}) AS VARCHAR) AS DECIMAL(38,18)), {digits}) AS DOUBLE)"


APN_SQL = r"NULLIF(upper(regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '[- ]', '', 'g')), '')"
APN_RAW_SQL = r"upper(regexp_replace(regexp_replace({c}, '^\s+|\s+$', '', 'g'), '[- ]', '', 'g'))"


def apn(c: str) -> str:
    return APN_SQL.format(c=c)


def payment_sql(loan: str, a: Assumptions, rate: float | None = None, years: int | None = None) -> str:
    r, f, n = annuity_terms(a.annual_rate if rate is None else rate, a.term_years if years is None else years)
    pay = f"{loan} / {d(float(n))}" if r == 0 else f"{loan} * {d(r)} * {d(f)} / {d(f - 1.0)}"
    return f"CASE WHEN {loan} <= 0 THEN {d(0.0)} ELSE {pay} END"


def silver_listings_cte() -> str:
    return f"""silver_listings AS (
  SELECT apn, listing_key, address, postal_code, property_type, list_price, annual_property_tax, monthly_hoa, has_hoa
  FROM (
    SELECT {apn('ParcelNumber')} AS apn, ListingKey AS listing_key, UnparsedAddress AS address,
      PostalCode AS postal_code, PropertyType AS property_type, ListPrice AS list_price,
      TaxAnnualAmount AS annual_property_tax, MonthlyHOAAmt AS monthly_hoa,
      coalesce(MonthlyHOAAmt > 0, false) AS has_hoa,
      row_number() OVER (PARTITION BY ListingKey ORDER BY ModificationTimestamp DESC NULLS LAST, seq DESC NULLS LAST) AS rn
    FROM fx_bronze WHERE ListingKey IS NOT NULL
  ) x WHERE rn = 1
)"""


def silver_estimates_cte() -> str:
    return f"""silver_value_estimates AS (
  SELECT apn, value_estimate, estimate_source FROM (
    SELECT apn, value_estimate, estimate_source,
      row_number() OVER (PARTITION BY apn, estimate_source ORDER BY as_of DESC NULLS LAST, l_orderkey DESC NULLS LAST,
        l_linenumber DESC NULLS LAST, l_partkey DESC NULLS LAST, l_suppkey DESC NULLS LAST) AS rn
    FROM (SELECT {apn('ParcelNumber')} AS apn, value_estimate, estimate_source, as_of, l_orderkey, l_linenumber,
            l_partkey, l_suppkey FROM fx_estimates) e
    WHERE apn IS NOT NULL AND value_estimate IS NOT NULL AND estimate_source IS NOT NULL
  ) x WHERE rn = 1
)"""


def triangulation_cte(method: str = "exact", a: Assumptions | None = None, name: str = "tri",
                      source: str = "silver_value_estimates") -> str:
    a = a or Assumptions()
    med = "median(value_estimate)" if method == "exact" else "quantile_disc(value_estimate, 0.5)"
    sp = f"CASE WHEN med <> 0 THEN (mx - mn) / med ELSE {d(1.0)} END"
    return f"""{name} AS (
  SELECT apn, {rnd('med', 2)} AS value_estimate, n_sources, {rnd(f'{sp}', 4)} AS spread_pct,
    CASE WHEN n_sources IS NULL THEN NULL WHEN n_sources < 2 THEN 'low'
         WHEN {sp} <= {d(a.high_spread)} THEN 'high' WHEN {sp} <= {d(a.medium_spread)} THEN 'medium'
         ELSE 'low' END AS value_confidence
  FROM (
    SELECT apn, CAST({med} AS DOUBLE) AS med, min(value_estimate) AS mn, max(value_estimate) AS mx,
      CAST(count(DISTINCT estimate_source) AS BIGINT) AS n_sources
    FROM {source} WHERE apn IS NOT NULL AND value_estimate > 0 GROUP BY apn
  ) g
)"""


def screen_cte(a: Assumptions | None = None, tri: str = "tri", name: str = "screen") -> str:
    a = a or Assumptions()
    pay = payment_sql("loan", a)
    return f"""{name}_in AS (
  SELECT l.apn, l.listing_key, l.address, l.postal_code, l.property_type, t.value_confidence,
    l.list_price, l.annual_property_tax, l.monthly_hoa, l.has_hoa,
    coalesce(t.value_estimate, l.list_price) AS v,
    coalesce(t.value_estimate, l.list_price) * {d(a.ltv_target)} AS loan,
    l.list_price * {d(a.rent_to_price_monthly)} AS rent,
    l.list_price * {d(a.closing_pct)} AS closing
  FROM silver_listings l LEFT JOIN {tri} t ON l.apn = t.apn
),
{name}_pit AS (
  SELECT *, {pay} + annual_property_tax / {d(12.0)} + {d(a.annual_insurance / 12.0)} + coalesce(monthly_hoa, {d(0.0)}) AS pit
  FROM {name}_in
),
{name} AS (
  SELECT apn, listing_key, address, postal_code, property_type, {rnd('v', 2)} AS value, value_confidence,
    {rnd('rent', 2)} AS est_monthly_rent, {rnd('pit', 2)} AS monthly_pitia,
    {rnd('CASE WHEN pit > 0 THEN rent / pit END', 3)} AS dscr,
    {rnd('CASE WHEN v > 0 THEN loan / v END', 4)} AS ltv,
    {rnd('v - list_price', 2)} AS instant_equity,
    {rnd(f'v - (list_price + closing + {d(0.0)})', 2)} AS equity_after_close,
    has_hoa, coalesce(monthly_hoa, {d(0.0)}) AS monthly_hoa,
    coalesce({rnd('CASE WHEN pit > 0 THEN rent / pit END', 3)} >= {d(a.dscr_threshold)}, false)
      AND coalesce({rnd('CASE WHEN v > 0 THEN loan / v END', 4)} <= {d(float(a.ltv_target) + 0.001)}, false) AS passes
  FROM {name}_pit
)"""


RANK_SQL = ("CAST(row_number() OVER (ORDER BY passes DESC NULLS LAST, equity_after_close DESC NULLS LAST, "
            "listing_key ASC NULLS LAST) AS BIGINT)")

GOLD_COLS = ("apn, listing_key, address, postal_code, property_type, value, value_confidence, est_monthly_rent, "
             "monthly_pitia, dscr, ltv, instant_equity, equity_after_close, has_hoa, monthly_hoa, passes")


def gold_ctes(a: Assumptions | None = None, method: str = "exact") -> str:
    """fx_bronze .. gold (ranked screen as ``gold``)."""
    return (
        f"WITH {CTES},\n{silver_listings_cte()},\n{silver_estimates_cte()},\n"
        f"{triangulation_cte(method, a)},\n{screen_cte(a)},\n"
        f"gold AS (SELECT {GOLD_COLS}, {RANK_SQL} AS rank_score FROM screen)"
    )


def with_base(*ctes: str) -> str:
    return "WITH " + ",\n".join((CTES,) + ctes)


def latest_bronze_cte(name: str = "latest_bronze") -> str:
    return f"""{name} AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY ListingKey ORDER BY ModificationTimestamp DESC NULLS LAST,
      seq DESC NULLS LAST) AS rn
    FROM fx_bronze WHERE ListingKey IS NOT NULL
  ) x WHERE rn = 1
)"""


def ml_features_ctes(a: Assumptions | None = None, tri: str = "tri") -> str:
    a = a or Assumptions()
    return f"""{latest_bronze_cte()},
ml_in AS (
  SELECT {apn('ParcelNumber')} AS apn, ListingKey AS listing_key, UnparsedAddress AS address,
    PostalCode AS postal_code, PropertyType AS property_type, ListPrice AS list_price, BedroomsTotal AS beds,
    BathroomsTotal AS baths, LivingArea AS sqft, TaxAnnualAmount AS annual_property_tax,
    coalesce(MonthlyHOAAmt, {d(0.0)}) AS monthly_hoa, coalesce(MonthlyHOAAmt, {d(0.0)}) > 0 AS has_hoa,
    source, CAST(NULL AS VARCHAR) AS search_url, {OWN_ESTIMATE} AS value_estimate
  FROM latest_bronze
),
ml_calc AS (
  SELECT m.*, t.value_confidence,
    m.list_price * {d(a.ltv_target)} AS loan, m.list_price * {d(a.rent_to_price_monthly)} AS rent,
    coalesce(m.value_estimate, m.list_price) AS v, m.list_price * {d(a.closing_pct)} AS closing
  FROM ml_in m LEFT JOIN {tri} t ON m.apn = t.apn
),
ml_pi AS (SELECT *, {payment_sql('loan', a)} AS pi FROM ml_calc),
ml_pit AS (
  SELECT *, pi + annual_property_tax / {d(12.0)} + {d(a.annual_insurance / 12.0)} + coalesce(monthly_hoa, {d(0.0)}) AS pit
  FROM ml_pi
),
ml_r AS (
  SELECT *, {rnd('CASE WHEN pit > 0 THEN rent / pit END', 3)} AS dscr_r, {rnd('CASE WHEN v > 0 THEN loan / v END', 4)} AS ltv_r,
    {rnd('v - list_price', 2)} AS ie_r
  FROM ml_pit
),
ml AS (
  SELECT beds, baths, sqft, list_price,
    CASE WHEN sqft IS NOT NULL AND sqft > 0 THEN list_price / sqft END AS price_per_sqft,
    annual_property_tax,
    CASE WHEN list_price IS NOT NULL AND list_price > 0 THEN annual_property_tax / list_price END AS tax_rate,
    monthly_hoa, has_hoa, property_type, postal_code,
    {rnd('rent', 2)} AS est_monthly_rent, {rnd('pi', 2)} AS monthly_pi, {rnd('pit', 2)} AS monthly_pitia,
    dscr_r AS dscr, ltv_r AS ltv, ie_r AS instant_equity,
    {rnd(f'v - (list_price + closing + {d(0.0)})', 2)} AS equity_after_close,
    coalesce(dscr_r >= {d(a.dscr_threshold)} AND ltv_r <= {d(a.max_ltv_for_target)} AND ie_r > 0, false)
      AS heuristic_investment_grade,
    apn, listing_key, address, source, search_url, value_estimate, value_confidence
  FROM ml_r
)"""
