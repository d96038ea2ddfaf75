"""Checks of the readers and sinks: saved pages, portal layouts, envelopes,
landing files, incremental pulls, the bronze stream and lanes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscreen import fixtures as fx
from dealscreen import oracle_sql as osql
from dealscreen.checks import register
from dealscreen.checks.core import bronze, estimates, listings
from dealscreen.sources import pages as pg
from dealscreen.sources import portal as pt

d = osql.d
PAGED = osql.with_base(f"p AS (SELECT *, {fx.PAGE_EXPR} AS page FROM fx_bronze)")
PORTAL_COLS = ["page_id", "source", "ListingKey", "ParcelNumber", "UnparsedAddress", "PostalCode", "ListPrice",
               "value_estimate", "BedroomsTotal", "BathroomsTotal", "LivingArea", "url", "estimate_source"]

# --------------------------------------------------------------------------- #
# Pages: titles and blocked detection on the provided `pages` table
# --------------------------------------------------------------------------- #
def blocked_pages(spark: SparkSession, sf: str) -> DataFrame:
    fx.table(spark, sf, "pages").createOrReplaceTempView("pages")
    return spark.sql(f"SELECT * FROM {fx.BLOCKED_PAGES_SQL}")


_TITLE_SQL = r"regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)"
register("page_block_filter", f"""
SELECT page_id, {_TITLE_SQL} AS title,
  contains({_TITLE_SQL}, 'ERROR') OR contains(lower({_TITLE_SQL}), 'captcha') AS blocked_a,
  contains(lower({_TITLE_SQL}), 'captcha') OR regexp_matches(html, '<[^>]*\\sid\\s*=\\s*["'']captcha["'']') AS blocked_b,
  contains(lower({_TITLE_SQL}), 'captcha') AS blocked_c
FROM {fx.BLOCKED_PAGES_SQL} p""")(
    lambda spark, sf: blocked_pages(spark, sf).select(
        "page_id", pg.page_title("html").alias("title"), pg.blocked(F.col("html"), "a").alias("blocked_a"),
        pg.blocked(F.col("html"), "b").alias("blocked_b"), pg.blocked(F.col("html"), "c").alias("blocked_c")))

register("page_unblocked_count", f"""
SELECT count(*) AS n_pages FROM {fx.BLOCKED_PAGES_SQL} p
WHERE NOT (contains(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1), 'ERROR')
        OR contains(lower(regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)), 'captcha'))""")(
    lambda spark, sf: pg.filter_blocked_pages(blocked_pages(spark, sf), "a").agg(
        F.count(F.lit(1)).alias("n_pages")))

# --------------------------------------------------------------------------- #
# JSON islands (first pattern that matches *and* parses)
# --------------------------------------------------------------------------- #
# Fixed value: the second island pattern used by the island pages.
STATE_PATTERN = r"(?s)window\.__PRELOADED_STATE__\s*=\s*(\{.*?\});\s*</script>"


def _islands(spark: SparkSession, sf: str) -> DataFrame:
    from dealscreen.functions import json as js

    pages = fx.island_pages(spark, sf)
    v = pg.extract_json_island(F.col("html"), [pg.NEXT_DATA_PATTERN, STATE_PATTERN])
    recs = js.as_list(js.get(v, "$.props.pageProps.searchResults"))
    return pages.select("page_id", F.explode(recs).alias("h")).select(
        "page_id", js.get("h", "$.id", "string").alias("listing_key"), js.get("h", "$.price", "double").alias("price"))


register("html_json_extract", PAGED + """
SELECT page AS page_id, ListingKey AS listing_key, ListPrice AS price FROM p WHERE page % 4 <> 3""")(_islands)

# --------------------------------------------------------------------------- #
# Portal layouts
# --------------------------------------------------------------------------- #
_EXPECTED = {
    "a": f"""SELECT page AS page_id, 'portal_a' AS source, 'portal_a_' || ListingKey AS ListingKey,
  'PUBLIC-portal_a-' || ListingKey AS ParcelNumber,
  CASE WHEN card THEN '' ELSE UnparsedAddress END AS UnparsedAddress,
  CASE WHEN card THEN '' ELSE PostalCode END AS PostalCode,
  CASE WHEN card THEN NULL ELSE NULLIF(ListPrice, 0) END AS ListPrice,
  CASE WHEN card THEN NULL ELSE NULLIF(ListPrice, 0) END AS value_estimate,
  CASE WHEN card THEN 0 ELSE BedroomsTotal END AS BedroomsTotal,
  CASE WHEN card THEN {d(0.0)} ELSE BathroomsTotal END AS BathroomsTotal,
  CASE WHEN card THEN NULL ELSE NULLIF(LivingArea, 0) END AS LivingArea,
  CASE WHEN card THEN '' ELSE '/home/' || ListingKey END AS url, 'public_search' AS estimate_source
FROM (SELECT *, {fx.CARD_ONLY_RULE} AS card FROM p) x WHERE NOT ({fx.BLOCKED_TITLE_RULE})""",
    "b": f"""SELECT page AS page_id, 'portal_b' AS source, 'portal_b_' || ListingKey AS ListingKey,
  'PUBLIC-portal_b-' || ListingKey AS ParcelNumber, UnparsedAddress, PostalCode, ListPrice,
  ListPrice AS value_estimate, BedroomsTotal, BathroomsTotal, LivingArea,
  '/homedetails/' || ListingKey AS url, 'public_search' AS estimate_source
FROM p WHERE NOT ({fx.BLOCKED_TITLE_RULE}) AND NOT ({fx.CAPTCHA_ELEMENT_RULE})""",
    "c": f"""SELECT page AS page_id, 'portal_c' AS source, 'portal_c_' || ListingKey AS ListingKey,
  'PUBLIC-portal_c-' || ListingKey AS ParcelNumber, UnparsedAddress, PostalCode, NULLIF(ListPrice, 0) AS ListPrice,
  NULLIF(ListPrice, 0) AS value_estimate, BedroomsTotal, BathroomsTotal, NULLIF(LivingArea, 0) AS LivingArea,
  '/listing/' || ListingKey AS url, 'public_search' AS estimate_source
FROM p WHERE NOT ({fx.BLOCKED_TITLE_RULE})""",
}


def _portal(layout: str):
    def q(spark: SparkSession, sf: str) -> DataFrame:
        return pt.map_portal(fx.portal_pages(spark, sf, layout), layout).select(*PORTAL_COLS)

    return q


for _lay in ("a", "b", "c"):
    register(f"portal_map_{_lay}", PAGED + "\n" + _EXPECTED[_lay])(_portal(_lay))

# Home-card records over every page: only the pages without a JSON island
# carry home cards, and blocked pages give nothing.
register("portal_card_fallback", PAGED + f"""
SELECT page AS page_id, 'portal_a_' || ListingKey AS ListingKey, '' AS UnparsedAddress
FROM p WHERE {fx.CARD_ONLY_RULE} AND NOT ({fx.BLOCKED_TITLE_RULE})""")(
    lambda spark, sf: pt.to_bronze(pt.map_portal_cards(fx.portal_pages(spark, sf, "a")), keep=["page_id"])
    .select("page_id", "ListingKey", "UnparsedAddress"))

# Search URLs for criteria taken from every listing version.
_CRIT_SQL = """SELECT seq, 'Town' || substr(PostalCode, 1, 3) AS city, 'TX' AS state, BedroomsTotal AS beds,
  CAST(floor(BathroomsTotal) AS INTEGER) AS baths, lower(PropertyType) AS property_type FROM fx_bronze"""


def _search_urls(spark: SparkSession, sf: str) -> DataFrame:
    c = bronze(spark, sf).selectExpr(
        "seq", "concat('Town', substr(PostalCode, 1, 3)) AS city", "'TX' AS state", "BedroomsTotal AS beds",
        "CAST(floor(BathroomsTotal) AS INT) AS baths", "lower(PropertyType) AS property_type")
    args = [F.col(x) for x in ("city", "state", "beds", "baths", "property_type")]
    return c.select("seq", *[pt.search_url_col(lay, *args).alias(f"url_{lay}") for lay in "abc"])


register("search_url_columns", osql.with_base() + f"""
SELECT seq,
  'https://www.redfin.com/city/17215/TX/' || city || '/filter/beds=' || CAST(beds AS VARCHAR) || '-baths='
    || CAST(baths AS VARCHAR) || '-property-type=' || property_type AS url_a,
  'https://www.zillow.com/' || lower(city) || '-' || lower(state) || '/' || CAST(beds AS VARCHAR) || '-beds-'
    || CAST(baths AS VARCHAR) || '-baths/' AS url_b,
  'https://www.movoto.com/' || lower(city) || '-' || lower(state) || '/' || CAST(beds AS VARCHAR) || 'b-'
    || CAST(baths AS VARCHAR) || 'b/for-sale/' AS url_c
FROM ({_CRIT_SQL}) c""")(_search_urls)


# Record -> bronze row mapping on records built from every listing version.
def _portal_records(spark: SparkSession, sf: str) -> DataFrame:
    return bronze(spark, sf).selectExpr(
        "seq", "'portal_b' AS source", "ListingKey AS listing_key", "UnparsedAddress AS address",
        "PostalCode AS postal_code", "ListPrice AS list_price", "'house' AS property_type",
        "BedroomsTotal AS beds", "BathroomsTotal AS baths", "LivingArea AS sqft",
        "TaxAnnualAmount AS annual_property_tax", "coalesce(MonthlyHOAAmt, 0.0) AS monthly_hoa",
        "CASE WHEN seq % 3 = 0 THEN '' ELSE trim(ParcelNumber) END AS apn",
        "CASE WHEN seq % 4 = 0 THEN 0.0D WHEN seq % 4 = 1 THEN NULL ELSE ListPrice * 1.05D END AS value_estimate",
        "'public_search' AS estimate_source",
    )


def _to_bronze(spark: SparkSession, sf: str) -> DataFrame:
    r = _portal_records(spark, sf)
    full = r.select("seq", *[F.col(n) if n in r.columns else F.lit(None).cast(t).alias(n)
                             for n, t in pt.PORTAL_RECORD_FIELDS])
    return pt.to_bronze(full, keep=["seq"]).select(
        "seq", "ParcelNumber", "ListingKey", "UnparsedAddress", "ListPrice", "value_estimate", "MonthlyHOAAmt")


_TO_BRONZE_SQL = osql.with_base() + f"""
SELECT seq, CASE WHEN seq % 3 = 0 OR trim(ParcelNumber) = '' OR ParcelNumber IS NULL
    THEN 'PUBLIC-portal_b-' || ListingKey ELSE trim(ParcelNumber) END AS ParcelNumber,
  'portal_b_' || ListingKey AS ListingKey, UnparsedAddress, ListPrice,
  coalesce(CASE WHEN seq % 4 IN (0, 1) THEN NULL ELSE NULLIF(ListPrice * {d(1.05)}, 0) END,
           ListPrice) AS value_estimate,
  coalesce(MonthlyHOAAmt, {d(0.0)}) AS MonthlyHOAAmt
FROM fx_bronze"""
register("portal_to_bronze", _TO_BRONZE_SQL)(_to_bronze)


# Two portal batches of the same listings land; read back as bronze, each listing's later version counts.
def _portal_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    import time

    from dealscreen.config import scratch_path
    from dealscreen.operators.dedup import dedup_latest
    from dealscreen.sources import files

    r = _portal_records(spark, sf).withColumn("city", F.concat(F.lit("C"), F.col("postal_code")))
    full = pt.to_bronze(r.select(*[F.col(n) if n in r.columns else F.lit(None).cast(t).alias(n)
                                   for n, t in pt.PORTAL_RECORD_FIELDS], "seq"), keep=["seq"])
    latest = dedup_latest(full, ["ListingKey"], ["seq"]).drop("seq")
    landing = scratch_path(spark, "landing-portal")
    files.write_portal_batch(latest.withColumn("ListPrice", F.lit(1.0)), landing)
    time.sleep(1.1)  # file times may be whole seconds
    files.write_portal_batch(latest, landing)
    rows = files.good_rows(files.read_portal(spark, landing))
    return dedup_latest(rows, ["ListingKey"], ["ModificationTimestamp"]).select(
        "ListingKey", "ParcelNumber", "ListPrice", "value_estimate", "City")


register("portal_landing_roundtrip", osql.with_base() + f"""
SELECT 'portal_b_' || ListingKey AS ListingKey, CASE WHEN seq % 3 = 0 OR trim(ParcelNumber) = '' OR ParcelNumber IS NULL
    THEN 'PUBLIC-portal_b-' || ListingKey ELSE trim(ParcelNumber) END AS ParcelNumber, ListPrice,
  coalesce(CASE WHEN seq % 4 IN (0, 1) THEN NULL ELSE NULLIF(ListPrice * {d(1.05)}, 0) END, ListPrice) AS value_estimate,
  'C' || PostalCode AS City
FROM (SELECT *, row_number() OVER (PARTITION BY ListingKey ORDER BY seq DESC) AS rn FROM fx_bronze) x
WHERE rn = 1""")(_portal_roundtrip)

# --------------------------------------------------------------------------- #
# Union of sources, fallback rows, counts, price bounds
# --------------------------------------------------------------------------- #


def _union(spark: SparkSession, sf: str) -> DataFrame:
    recs = {f"portal_{lay}": pt.map_portal(fx.portal_pages(spark, sf, lay), lay) for lay in "abc"}
    # An unknown source is requested too: it is skipped, the others continue.
    out = pt.collect_sources(recs, ["portal_a", "portal_x", "portal_b", "portal_c"])
    return out.select("source", "ListingKey", "ListPrice")


register("source_union", PAGED + "\n, e AS (" + " UNION ALL ".join(
    f"SELECT source, ListingKey, ListPrice FROM ({_EXPECTED[lay]}) x{lay}" for lay in "abc") + ")\nSELECT * FROM e")(
    _union)


def _fallback(spark: SparkSession, sf: str) -> DataFrame:
    # Pages only for a and b: c produced nothing and gets its search-URL row.
    recs = {f"portal_{lay}": pt.map_portal(fx.portal_pages(spark, sf, lay), lay) for lay in "ab"}
    found = pt.collect_sources(recs)
    return pt.source_fallback(spark, found).select(
        "source", "ListingKey", "ParcelNumber", "UnparsedAddress", "BedroomsTotal", "BathroomsTotal",
        "estimate_source", "search_url")


register("source_fallback_rows", PAGED + f"""
, present AS (SELECT DISTINCT 'portal_a' AS source FROM p WHERE NOT ({fx.BLOCKED_TITLE_RULE})
              UNION SELECT DISTINCT 'portal_b' FROM p WHERE NOT ({fx.BLOCKED_TITLE_RULE}) AND NOT ({fx.CAPTCHA_ELEMENT_RULE})),
wanted AS (SELECT * FROM (VALUES ('portal_a'), ('portal_b'), ('portal_c')) t(source))
SELECT source, source || '_' || source || '_search_url' AS ListingKey,
  'PUBLIC-' || source || '-' || source || '_search_url' AS ParcelNumber, 'Richardson, TX' AS UnparsedAddress,
  3 AS BedroomsTotal, {d(2.0)} AS BathroomsTotal, 'public_search_url' AS estimate_source,
  CASE source WHEN 'portal_a' THEN 'https://www.redfin.com/city/17215/TX/Richardson/filter/beds=3-baths=2-property-type=house'
              WHEN 'portal_b' THEN 'https://www.zillow.com/richardson-tx/3-beds-2-baths/'
              ELSE 'https://www.movoto.com/richardson-tx/3b-2b/for-sale/' END AS search_url
FROM wanted WHERE source NOT IN (SELECT source FROM present)""")(_fallback)

register("source_counts", osql.with_base() + """
SELECT source, count(*) AS n_records FROM fx_bronze GROUP BY source""")(
    lambda spark, sf: pt.source_counts(bronze(spark, sf)))

register("listing_price_filter", osql.with_base(osql.silver_listings_cte()) + f"""
SELECT listing_key, list_price FROM silver_listings WHERE list_price >= {d(150000.0)} AND list_price <= {d(300000.0)}""")(
    lambda spark, sf: pt.search_filter(listings(spark, sf), 150000, 300000).select("listing_key", "list_price"))

register("listing_min_price_filter", osql.with_base(osql.silver_listings_cte()) + f"""
SELECT listing_key, list_price FROM silver_listings WHERE list_price >= {d(400000.0)}""")(
    lambda spark, sf: pt.search_filter(listings(spark, sf), min_price=400000).select("listing_key", "list_price"))

# --------------------------------------------------------------------------- #
# Lanes
# --------------------------------------------------------------------------- #


def _lanes(spark: SparkSession, sf: str) -> DataFrame:
    from dealscreen.config import lane_column

    e = estimates(spark, sf).withColumn("lane", lane_column("estimate_source"))
    return e.groupBy("lane", "estimate_source").agg(F.count(F.lit(1)).alias("n_rows"))


register("lane_row_counts", osql.with_base(osql.silver_estimates_cte()) + """
SELECT CASE WHEN estimate_source IN ('county') THEN 'public' ELSE 'licensed' END AS lane, estimate_source,
  count(*) AS n_rows
FROM silver_value_estimates GROUP BY 1, 2""")(_lanes)


# Price texts with and without scale letters, built from every listing version.
_PRICE_TEXT = """CASE seq % 6 WHEN 0 THEN '$1.2M' WHEN 1 THEN concat('$', CAST(seq AS STRING), 'k') WHEN 2 THEN concat('$', CAST(seq AS STRING), ',000')
  WHEN 3 THEN concat(CAST(seq AS STRING), ' - ', CAST(seq + 1 AS STRING)) WHEN 4 THEN NULL ELSE concat('USD ', CAST(seq AS STRING), '.50 monthly') END"""


def _suspicious(spark: SparkSession, sf: str) -> DataFrame:
    from dealscreen.functions.text import suspicious_price

    return bronze(spark, sf).selectExpr("seq", f"{_PRICE_TEXT} AS price").select("seq", suspicious_price("price").alias("suspicious_price"))


register("suspicious_price", osql.with_base() + "\nSELECT seq, seq % 6 IN (0, 1, 3) AS suspicious_price FROM fx_bronze")(_suspicious)
