"""Listings and estimate feeds derived from the provided star-schema tables.

Six orders make one parcel (two listings of three versions each), so the
derived feeds contain stale versions, blank and null parcel numbers, null
prices, taxes and HOA dues, and parcels with zero to three estimate sources.
The expressions are plain SQL that Spark and DuckDB evaluate identically;
``BRONZE_SQL`` / ``ESTIMATES_SQL`` are the same adapter as text for oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The adapter expressions over `orders` / `lineitem`.
BRONZE_EXPRS = [
    "CASE WHEN pid % 51 = 0 THEN NULL WHEN pid % 50 = 0 THEN '  ' "
    "ELSE concat(' ', lpad(CAST(pid AS STRING), CAST(greatest(6, length(CAST(pid AS STRING))) AS INT), '0'), '-ab ', CAST(pid % 7 AS STRING), ' ') END AS ParcelNumber",
    "concat('L', CAST(lid AS STRING)) AS ListingKey",
    "concat(CAST(o_custkey AS STRING), ' Main St') AS UnparsedAddress",
    "lpad(CAST(o_custkey AS STRING), CAST(greatest(5, length(CAST(o_custkey AS STRING))) AS INT), '0') AS PostalCode",
    "o_orderpriority AS PropertyType",
    "CASE WHEN o_orderkey % 97 = 0 THEN NULL "
    "ELSE floor(base * (90 + CAST(floor(o_totalprice) AS BIGINT) % 21) / 100) * 1.0E0 END AS ListPrice",
    "CASE WHEN o_orderkey % 89 = 0 THEN NULL ELSE floor(base / 100) * 1.0E0 END AS TaxAnnualAmount",
    "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 0.0E0 "
    "ELSE (o_orderkey % 60) * 1.0E0 END AS MonthlyHOAAmt",
    "CAST(o_orderkey % 6 AS INT) AS BedroomsTotal",
    "(o_orderkey % 5) * 0.5E0 AS BathroomsTotal",
    "(o_custkey % 30) * 100.0E0 AS LivingArea",
    "CASE WHEN o_orderkey % 5 = 0 THEN 'reso' WHEN o_orderkey % 5 < 3 THEN 'portal_a' ELSE 'portal_b' END AS source",
    "o_orderdate AS ModificationTimestamp",
    "o_orderkey AS seq",
    "pid",
    "base",
]
KEY_EXPRS = [
    "CAST(floor(o_orderkey / 6) AS BIGINT) AS pid",
    "CAST(floor(o_orderkey / 3) AS BIGINT) AS lid",
]
BASE_EXPR = "100000 + (pid * 7919) % 400000 AS base"
ESTIMATE_EXPRS = [
    "b.ParcelNumber AS ParcelNumber",
    "floor(b.base * (94 + l.l_partkey % 13) / 100) * 1.0E0 AS value_estimate",
    "CASE l.l_returnflag WHEN 'A' THEN 'avm' WHEN 'N' THEN 'county' ELSE 'mls_list' END AS estimate_source",
    "l.l_shipdate AS as_of",
    "l.l_orderkey AS l_orderkey",
    "l.l_linenumber AS l_linenumber",
    "l.l_partkey AS l_partkey",
    "l.l_suppkey AS l_suppkey",
]

# A listing's own estimate, missing for every fourth version (for the feature table's label).
OWN_ESTIMATE = "CASE WHEN seq % 4 = 0 THEN NULL ELSE floor(base * (80 + seq % 60) / 100) * 1.0E0 END"

# Some of the provided pages as portals show them to robots: an error title, a captcha title, a captcha element.
BLOCKED_PAGES_SQL = """(SELECT page_id, CASE WHEN page_id % 9 = 5 THEN replace(html, '<title>', '<title>ERROR ')
  WHEN page_id % 11 = 3 THEN replace(html, '<title>', '<title>Captcha ')
  WHEN page_id % 13 = 4 THEN replace(html, '<body>', '<body><div id="captcha"></div>') ELSE html END AS html FROM pages)"""

# Total order that makes the latest estimate of the adapter deterministic.
ESTIMATE_ORDER = ["as_of", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]

BRONZE_SQL = (
    "SELECT " + ",\n  ".join(BRONZE_EXPRS) + "\nFROM (\n  SELECT *, " + BASE_EXPR + "\n  FROM (SELECT *, "
    + ", ".join(KEY_EXPRS) + " FROM orders) o1\n) o2"
)
ESTIMATES_SQL = (
    "SELECT " + ",\n  ".join(ESTIMATE_EXPRS)
    + "\nFROM fx_bronze b JOIN lineitem l ON l.l_orderkey = b.seq"
)
CTES = f"fx_bronze AS (\n{BRONZE_SQL}\n),\nfx_estimates AS (\n{ESTIMATES_SQL}\n)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def bronze_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing versions (RESO-style columns) derived from ``orders``."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"
    )
    return orders.selectExpr("*", *KEY_EXPRS).selectExpr("*", BASE_EXPR).selectExpr(*BRONZE_EXPRS)


def estimate_feed(spark: SparkSession, sf_dir: str, bronze: DataFrame | None = None) -> DataFrame:
    """Independent value estimates (avm / county / mls_list) per listing version."""
    b = (bronze if bronze is not None else bronze_listings(spark, sf_dir)).select("ParcelNumber", "base", "seq").alias("b")
    li = (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate")
        .alias("l")
    )
    return b.join(li, b["seq"] == li["l_orderkey"]).selectExpr(*ESTIMATE_EXPRS)


# --------------------------------------------------------------------------- #
# Saved pages built from the listing versions (for the page / portal readers)
# --------------------------------------------------------------------------- #
# Rows per page and the page-number rules of the generated pages.
ROWS_PER_PAGE = 20
ROWS_PER_ENVELOPE = 1000
PAGE_EXPR = f"CAST(floor(seq / {ROWS_PER_PAGE}) AS BIGINT)"
BLOCKED_TITLE_RULE = "page % 9 = 5"        # title reads like a captcha interstitial
CARD_ONLY_RULE = "page % 11 = 7"           # layout a: no JSON island, home cards only
CAPTCHA_ELEMENT_RULE = "page % 13 = 3"     # layout b: a #captcha element on the page

_RECORD_EXPRS = {
    "a": """to_variant_object(named_struct(
        'id', CASE WHEN seq % 2 = 0 THEN ListingKey END,
        'listingId', CASE WHEN seq % 2 = 1 THEN ListingKey END,
        'price', CASE WHEN seq % 7 <> 0 THEN ListPrice END,
        'listPrice', CASE WHEN seq % 7 = 0 THEN ListPrice END,
        'address', CASE WHEN seq % 3 = 0 THEN to_variant_object(named_struct('streetAddress', UnparsedAddress))
                        ELSE CAST(UnparsedAddress AS VARIANT) END,
        'zipCode', CASE WHEN seq % 2 = 0 THEN PostalCode END,
        'zip', CASE WHEN seq % 2 = 1 THEN PostalCode END,
        'beds', BedroomsTotal, 'baths', BathroomsTotal, 'sqft', LivingArea,
        'url', concat('/home/', ListingKey)))""",
    "b": """to_variant_object(named_struct(
        'zpid', CASE WHEN seq % 2 = 0 THEN ListingKey END,
        'id', CASE WHEN seq % 2 = 1 THEN ListingKey END,
        'price', CASE WHEN seq % 5 <> 0 THEN concat('$', format_number(ListPrice, 0)) END,
        'listPrice', CASE WHEN seq % 5 = 0 THEN concat('$', format_number(ListPrice, 0)) END,
        'address', CASE WHEN seq % 2 = 0 THEN UnparsedAddress END,
        'addressStreet', CASE WHEN seq % 2 = 1 THEN UnparsedAddress END,
        'zipcode', CASE WHEN seq % 3 = 0 THEN PostalCode END,
        'zip', CASE WHEN seq % 3 <> 0 THEN PostalCode END,
        'beds', CASE WHEN seq % 4 <> 0 THEN BedroomsTotal END,
        'bedrooms', CASE WHEN seq % 4 = 0 THEN BedroomsTotal END,
        'baths', BathroomsTotal,
        'area', concat(format_number(LivingArea, 0), ' sqft'),
        'detailUrl', concat('/homedetails/', ListingKey)))""",
    "c": """to_variant_object(named_struct(
        'id', CASE WHEN seq % 2 = 0 THEN ListingKey END,
        'listingId', CASE WHEN seq % 2 = 1 THEN ListingKey END,
        'price', ListPrice,
        'address', CASE WHEN seq % 3 = 1 THEN to_variant_object(named_struct('streetAddress', UnparsedAddress))
                        ELSE CAST(UnparsedAddress AS VARIANT) END,
        'zip', CASE WHEN seq % 2 = 1 THEN PostalCode END,
        'postalCode', CASE WHEN seq % 2 = 0 THEN PostalCode END,
        'bedrooms', BedroomsTotal, 'baths', BathroomsTotal,
        'livingArea', LivingArea, 'url', concat('/listing/', ListingKey)))""",
}

_PROPS_EXPRS = {
    "a": """CASE
        WHEN page % 4 = 0 THEN to_variant_object(named_struct('searchResults', recs))
        WHEN page % 4 = 1 THEN to_variant_object(named_struct('searchResults', CAST(array() AS ARRAY<VARIANT>), 'listings', recs))
        WHEN page % 4 = 2 THEN to_variant_object(named_struct('homes', recs))
        ELSE to_variant_object(named_struct('searchResults', to_json(recs))) END""",
    "b": """CASE
        WHEN page % 2 = 0 THEN to_variant_object(named_struct('searchPageState',
             named_struct('cat1', named_struct('searchResults', recs))))
        ELSE to_variant_object(named_struct('searchPageState', named_struct('cat1', named_struct('searchResults', CAST(array() AS ARRAY<VARIANT>))),
             'initialSearchState', named_struct('listings', recs))) END""",
    "c": """CASE WHEN page % 2 = 0 THEN to_variant_object(named_struct('listings', recs))
        ELSE to_variant_object(named_struct('searchResults', recs)) END""",
}


# Home cards as portals write them: either quote, none, entities, any order, other elements and comments between them.
_CARD_EXPR = """CASE seq % 6
    WHEN 0 THEN concat('<div class="card" data-rf-test-id="homecard" id="', ListingKey, '"></div>')
    WHEN 1 THEN concat('<div id=', chr(39), ListingKey, chr(39), ' data-rf-test-id=', chr(39), 'homecard', chr(39), ' title="a > b"></div>')
    WHEN 2 THEN concat('<!-- <div data-rf-test-id="homecard" id="no"> --><DIV DATA-RF-TEST-ID=homecard ID=', ListingKey, '></DIV>')
    WHEN 3 THEN concat('<div hidden data-rf-test-id = "homecard"', chr(10), ' id = "', ListingKey, '" /><div data-id="x" title="data-rf-test-id=homecard id=y"></div>')
    WHEN 4 THEN concat('<div data-id="x" data-rf-test-id="&#104;omecar"></div><div id="', ListingKey, '" data-rf-test-id="&#104;&#x6f;mecard" id="second"></div>')
    ELSE concat('<script>var c = "<div data-rf-test-id=homecard id=z>";</script><div data-rf-test-id="homecard" id="', ListingKey, '" title="', chr(39), '"></div>') END"""


def portal_pages(spark: SparkSession, sf_dir: str, layout: str) -> DataFrame:
    """One saved results page per ``ROWS_PER_PAGE`` listing versions, in the
    given portal layout (JSON island, blocked titles, card-only pages).

    Pages group rows by ``seq``, a unique key, so a page never holds more
    than ``ROWS_PER_PAGE`` records however large the table is.
    """
    b = bronze_listings(spark, sf_dir).selectExpr("*", f"{PAGE_EXPR} AS page")
    pages = b.groupBy("page").agg(
        F.expr(f"collect_list({_RECORD_EXPRS[layout]})").alias("recs"),
        F.expr(f"collect_list({_CARD_EXPR})")
        .alias("cards"),
    )
    title = f"CASE WHEN {BLOCKED_TITLE_RULE} THEN 'Captcha check' ELSE concat('Homes for sale, page ', CAST(page AS STRING)) END"
    island = ("concat('<script id=\"__NEXT_DATA__\" type=\"application/json\">', "
              f"to_json(to_variant_object(named_struct('props', named_struct('pageProps', {_PROPS_EXPRS[layout]})))), "
              "'</script>')")
    body = f"CASE WHEN {CARD_ONLY_RULE} THEN array_join(cards, '') ELSE {island} END" if layout == "a" else island
    captcha = f"CASE WHEN {CAPTCHA_ELEMENT_RULE} THEN '<div id=\"captcha\"></div>' ELSE '' END" if layout == "b" else "''"
    return pages.selectExpr(
        "page AS page_id",
        f"concat('<html><head><title>', {title}, '</title></head><body>', {captcha}, {body}, '</body></html>') AS html",
    )


def island_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose data sits in one of two island patterns, some broken."""
    b = bronze_listings(spark, sf_dir).selectExpr("*", f"{PAGE_EXPR} AS page")
    pages = b.groupBy("page").agg(
        F.expr("collect_list(named_struct('id', ListingKey, 'price', ListPrice))").alias("recs"))
    good = "to_json(named_struct('props', named_struct('pageProps', named_struct('searchResults', recs))))"
    broken = "'<script id=\"__NEXT_DATA__\" type=\"application/json\">{\"props\": </script>'"
    nd = f"concat('<script id=\"__NEXT_DATA__\" type=\"application/json\">', {good}, '</script>')"
    state = f"concat('<script>window.__PRELOADED_STATE__ = ', {good}, ';</script>')"
    body = (f"CASE page % 4 WHEN 0 THEN {nd} WHEN 1 THEN concat({broken}, {state}) "
            f"WHEN 2 THEN concat('<script>var x = 1;</script>', {nd}) ELSE {broken} END")
    return pages.selectExpr("page AS page_id", f"concat('<html><body>', {body}, '</body></html>') AS html")


def envelope_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paged result envelopes (``value`` array + next link), one text row per page."""
    b = bronze_listings(spark, sf_dir).selectExpr("*", f"CAST(floor(seq / {ROWS_PER_ENVELOPE}) AS BIGINT) AS page")
    pages = b.groupBy("page").agg(F.expr(
        "collect_list(named_struct('ListingKey', ListingKey, 'ListPrice', ListPrice, "
        "'ModificationTimestamp', ModificationTimestamp, 'seq', seq))").alias("recs"))
    return pages.selectExpr(
        "page",
        "to_json(named_struct('value', CASE WHEN page % 5 <> 4 THEN recs END, "
        f"'@odata.nextLink', concat('Property?$top={ROWS_PER_ENVELOPE}&$skip=', CAST((page + 1) * {ROWS_PER_ENVELOPE} AS STRING)))) AS body")


# --------------------------------------------------------------------------- #
# Result pages that are linked to each other (some chains are broken)
# --------------------------------------------------------------------------- #
# Rows a page, pages a feed, the service's address, and the rules that break the feeds' chains.
ROWS_PER_LINKED_PAGE, PAGES_PER_FEED = 50, 32
LINK_BASE = "https://api.example.com/odata"
LINKED_PAGE = f"CAST(floor(seq / {ROWS_PER_LINKED_PAGE}) AS BIGINT)"
LINK_MISSING = "feed % 5 = 1 AND i = 19"                       # the page was never delivered
LINK_CUT = "feed % 5 = 4 AND i = 25"                           # the page lost its end
LINK_REPEATED = "(feed % 5 IN (0, 3) AND i = 3) OR (feed % 5 = 3 AND i = 14)"
LINK_NEXT = (f"CASE WHEN page = last_page OR i = {PAGES_PER_FEED - 1} THEN NULL WHEN feed % 5 = 2 AND i = 21 THEN 8 "
             "WHEN feed % 5 = 3 AND i = 13 THEN 15 ELSE i + 1 END")  # a cycle; a page that is left out


def linked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feed, url, delivery, body: envelopes whose links are absolute or relative; repeated pages first came without records."""
    b = bronze_listings(spark, sf_dir).selectExpr("*", f"{LINKED_PAGE} AS page")
    last = b.agg(F.max("page")).first()[0]
    pages = b.groupBy("page").agg(F.expr(
        "collect_list(named_struct('ListingKey', ListingKey, 'ListPrice', ListPrice, "
        "'ModificationTimestamp', ModificationTimestamp, 'seq', seq))").alias("recs"))
    pages = pages.selectExpr("page", "recs", f"page div {PAGES_PER_FEED} AS feed", f"page % {PAGES_PER_FEED} AS i", f"{last} AS last_page")
    pages = pages.where(f"NOT ({LINK_MISSING})").selectExpr("*", f"{LINK_NEXT} AS nxt").selectExpr(
        "*", f"concat(CASE WHEN i % 3 = 0 THEN '{LINK_BASE}/' WHEN i % 3 = 1 THEN '/' ELSE '' END, 'page-', feed, '-', nxt) AS link")
    body = "to_json(named_struct('value', {recs}, '@odata.nextLink', coalesce(link, '')))"
    pages = pages.selectExpr("*", body.format(recs="recs") + " AS full", body.format(recs="slice(recs, 1, 1)") + " AS early",
                             f"{LINK_REPEATED} AS twice", f"{LINK_CUT} AS cut")
    return pages.selectExpr("CAST(feed AS STRING) AS feed", "concat('page-', feed, '-', i) AS url",
                            "CASE WHEN cut THEN array(substring(full, 1, length(full) - 40)) WHEN twice THEN array(early, full) "
                            "ELSE array(full) END AS bodies").selectExpr("feed", "url", "posexplode(bodies) AS (delivery, body)")
