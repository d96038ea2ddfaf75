"""Listing-portal pages -> bronze listing rows, as DataFrame transformations.

Three page layouts ("a", "b", "c") are understood. Each saved page row is
parsed on the executors: blocked pages are dropped, the embedded JSON island
is navigated with key fallbacks, and every home record becomes one row. A
bad record only nulls its own fields; it never discards its page or source.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscreen.functions import json as js
from dealscreen.functions.text import nullif_zero, number_from_text
from dealscreen.schemas import PORTAL_RECORD_FIELDS, PORTAL_SCHEMA
from dealscreen.sources.pages import NEXT_DATA_PATTERN, extract_json_island, filter_blocked_pages, homecard_ids

logger = logging.getLogger(__name__)


@dataclass(frozen=True)
class SearchCriteria:
    # Default search criteria.
    city: str = "Richardson"
    state: str = "TX"
    beds: int = 3
    baths: int = 2
    property_type: str = "house"
    max_price: float | None = None
    min_price: float | None = None


# Source name -> page layout. Unknown names are skipped with a warning.
DEFAULT_SOURCES: dict[str, str] = {"portal_a": "a", "portal_b": "b", "portal_c": "c"}

# Search-URL templates per layout, the estimate-source labels of
# found and fallback rows, the parcel prefix of records without a parcel number
# and the key suffix of fallback rows.
#   a: https://www.redfin.com/city/17215/TX/{city}/filter/beds={beds}-baths={baths}-property-type={property_type}
#   b: https://www.zillow.com/{city lower}-{state lower}/{beds}-beds-{baths}-baths/
#   c: https://www.movoto.com/{city lower}-{state lower}/{beds}b-{baths}b/for-sale/
DEFAULT_ESTIMATE_SOURCE = "public_search"
FALLBACK_ESTIMATE_SOURCE = "public_search_url"
NO_PARCEL_PREFIX = "PUBLIC-"
FALLBACK_KEY_SUFFIX = "_search_url"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def search_url_col(layout: str, city, state, beds, baths, property_type) -> Column:
    city, state, beds, baths, ptype = (_c(x) for x in (city, state, beds, baths, property_type))
    beds, baths = beds.cast("string"), baths.cast("string")
    if layout == "a":
        return F.concat(F.lit("https://www.redfin.com/city/17215/TX/"), city, F.lit("/filter/beds="), beds,
                        F.lit("-baths="), baths, F.lit("-property-type="), ptype)
    slug = F.concat(F.lower(city), F.lit("-"), F.lower(state))
    if layout == "b":
        return F.concat(F.lit("https://www.zillow.com/"), slug, F.lit("/"), beds, F.lit("-beds-"), baths,
                        F.lit("-baths/"))
    if layout == "c":
        return F.concat(F.lit("https://www.movoto.com/"), slug, F.lit("/"), beds, F.lit("b-"), baths,
                        F.lit("b/for-sale/"))
    raise ValueError(f"unknown layout {layout!r}")


def _record_fields(source: str, c: SearchCriteria, **fields: Column) -> dict[str, Column]:
    """A portal record's fields by name, defaults filled in."""
    defaults = {
        "source": F.lit(source), "listing_key": F.lit(""), "address": F.lit(""), "city": F.lit(c.city),
        "state": F.lit(c.state), "postal_code": F.lit(""), "list_price": F.lit(None),
        "property_type": F.lit(c.property_type), "beds": F.lit(0), "baths": F.lit(0.0), "sqft": F.lit(None),
        "lot_sqft": F.lit(None), "year_built": F.lit(None), "url": F.lit(""), "annual_property_tax": F.lit(None),
        "monthly_hoa": F.lit(0.0), "has_hoa": F.lit(False), "apn": F.lit(""), "value_estimate": F.lit(None),
        "estimate_source": F.lit(DEFAULT_ESTIMATE_SOURCE),
    }
    return {n: v.cast(dict(PORTAL_RECORD_FIELDS)[n]) for n, v in (defaults | fields).items()}


def _record(source: str, c: SearchCriteria, **fields: Column) -> Column:
    """A portal record struct in the fixed field order."""
    made = _record_fields(source, c, **fields)
    return F.struct(*[made[n].alias(n) for n, _ in PORTAL_RECORD_FIELDS])


# JSON keys of a home record per layout and field, in fallback
# order, and the paths of the result list per layout, in order of preference.
RECORD_KEYS = {
    "a": {"listing_key": ["id", "listingId"], "price": ["price", "listPrice"], "postal_code": ["zipCode", "zip"],
          "beds": ["beds", "bedrooms"], "baths": ["baths", "bathrooms"], "sqft": ["sqft", "livingArea"],
          "url": ["url", "listingUrl"]},
    "b": {"listing_key": ["zpid", "id"], "price": ["price", "listPrice"], "address": ["address", "addressStreet"],
          "postal_code": ["zipcode", "zip"], "beds": ["beds", "bedrooms"], "baths": ["baths", "bathrooms"],
          "sqft": ["area", "livingArea"], "url": ["detailUrl", "url"]},
    "c": {"listing_key": ["id", "listingId"], "price": ["price"], "postal_code": ["zip", "postalCode"],
          "beds": ["bedrooms", "beds"], "baths": ["bathrooms", "baths"], "sqft": ["sqft", "livingArea"],
          "url": ["url"]},
}
RESULT_PATHS = {
    "a": ["searchResults", "listings", "homes"],
    "b": ["searchPageState.cat1.searchResults", "initialSearchState.listings"],
    "c": ["listings", "searchResults"],
}


def _paths(layout: str, field: str) -> list[str]:
    return [f"$.{k}" for k in RECORD_KEYS[layout][field]]


def _address(h: Column) -> Column:
    """``address.streetAddress`` when the address is an object, else the address text."""
    a = js.get(h, "$.address")
    return F.when(js.kind(a) == "OBJECT", js.text_of(a, "$.streetAddress")).otherwise(js.text_of(h, "$.address"))


def _common(h: Column, layout: str, c: SearchCriteria) -> dict[str, Column]:
    return {
        "listing_key": js.first(h, _paths(layout, "listing_key"), "string", ""),
        "city": F.coalesce(js.get(h, "$.city", "string"), F.lit(c.city)),
        "state": F.coalesce(js.get(h, "$.state", "string"), F.lit(c.state)),
        "postal_code": js.first(h, _paths(layout, "postal_code"), "string", ""),
        "beds": js.first(h, _paths(layout, "beds"), "int", 0),
        "baths": js.first(h, _paths(layout, "baths"), "double", 0.0),
        "url": js.first(h, _paths(layout, "url"), "string", ""),
    }


def _fields_a(h: Column, c: SearchCriteria) -> dict[str, Column]:
    price = nullif_zero(js.first(h, _paths("a", "price"), "double", 0.0))
    sqft = nullif_zero(js.first(h, _paths("a", "sqft"), "double", 0.0))
    return {**_common(h, "a", c), "address": _address(h), "list_price": price, "sqft": sqft, "value_estimate": price}


def _fields_b(h: Column, c: SearchCriteria) -> dict[str, Column]:
    """Price and area arrive as display text ("$350,000", "1,200 sqft")."""
    price = number_from_text(js.first(h, _paths("b", "price"), "string", ""))
    sqft = number_from_text(js.first(h, _paths("b", "sqft"), "string", ""))
    address = js.first(h, _paths("b", "address"), "string", "")
    return {**_common(h, "b", c), "address": address, "list_price": price, "sqft": sqft, "value_estimate": price}


def _fields_c(h: Column, c: SearchCriteria) -> dict[str, Column]:
    price = nullif_zero(js.first(h, _paths("c", "price"), "double", 0.0))
    sqft = nullif_zero(js.first(h, _paths("c", "sqft"), "double", 0.0))
    return {**_common(h, "c", c), "address": _address(h), "list_price": price, "sqft": sqft, "value_estimate": price}


def _results(cands: list[Column], layout: str) -> Column:
    """a: first non-empty candidate, a JSON string holding a list is parsed;
    b: first non-empty candidate; c: first present candidate."""
    if layout == "a":
        return js.as_list(js.first_truthy_of(cands), parse_strings=True)
    if layout == "b":
        return js.as_list(js.first_truthy_of(cands))
    if layout == "c":
        return js.as_list(F.coalesce(*cands))
    raise ValueError(f"unknown layout {layout!r}")


_FIELDS = {"a": _fields_a, "b": _fields_b, "c": _fields_c}


def map_portal_records(pages: DataFrame, layout: str, source: str | None = None,
                       criteria: SearchCriteria | None = None, patterns: Sequence[str] = (NEXT_DATA_PATTERN,),
                       html_col: str = "html", card_fallback: bool | None = None) -> DataFrame:
    """Saved pages of one layout -> portal records (lower-case fields).

    Layout "a" falls back to one key-only record per home-card element on
    pages whose JSON gave no records. The page is parsed once: each stage is
    its own projection, so the island and result list are not re-evaluated
    per field. Fields are columns over a row per record, so a query that asks
    for some computes no others.
    """
    c = criteria or SearchCriteria()
    src = source or f"portal_{layout}"
    keep = [x for x in pages.columns if x != html_col]
    ok = filter_blocked_pages(pages, layout, html_col)
    use_cards = card_fallback if card_fallback is not None else layout == "a"
    if layout not in RESULT_PATHS:
        raise ValueError(f"unknown layout {layout!r}")
    page = [html_col] if use_cards else []
    parsed = ok.select(*keep, *page, js.get(extract_json_island(F.col(html_col), patterns), "$.props.pageProps").alias("_props"))
    cands = parsed.select(*keep, *page, *[js.get("_props", f"$.{p}").alias(f"_c{i}") for i, p in enumerate(RESULT_PATHS[layout])])
    n = len(RESULT_PATHS[layout])
    listed = cands.select(*keep, *page, _results([F.col(f"_c{i}") for i in range(n)], layout).alias("_results"))
    # A row per record first, its fields then: only those that are asked for are read from it.
    item = lambda h, i: F.struct(h.cast("variant").alias("_home"), i.cast("string").alias("_card"))
    items = F.transform("_results", lambda h: item(h, F.lit(None)))
    if use_cards:
        # Elements are looked for only on pages without results.
        cards = F.transform(homecard_ids(F.col(html_col)), lambda i: item(F.lit(None), i))
        items = F.when(F.size("_results") > 0, items).otherwise(cards)
    rows = listed.select(*keep, F.inline(items))
    fields, found = _record_fields(src, c, **_FIELDS[layout](F.col("_home"), c)), F.col("_card").isNull()
    if use_cards:
        of_card = _record_fields(src, c, listing_key=F.col("_card"))
        fields = {f: F.when(found, v).otherwise(of_card[f]) for f, v in fields.items()} | {"source": F.lit(src)}
    return rows.select(*keep, *[fields[f].cast(t).alias(f) for f, t in PORTAL_RECORD_FIELDS])


def map_portal_cards(pages: DataFrame, source: str = "portal_a", criteria: SearchCriteria | None = None,
                     html_col: str = "html") -> DataFrame:
    """Home-card records only (pages without a usable JSON island)."""
    c = criteria or SearchCriteria()
    keep = [x for x in pages.columns if x != html_col]
    cards = F.transform(homecard_ids(F.col(html_col)), lambda i: _record(source, c, listing_key=i))
    return filter_blocked_pages(pages, "a", html_col).select(*keep, F.inline(cards))


def to_bronze(records: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Portal records -> bronze rows: record fields plus the RESO-style keys.

    The parcel number falls back to ``PUBLIC-<source>-<key>`` when the
    record has none; the listing key becomes ``<source>_<key>``; the value
    estimate falls back to the list price when missing or zero.
    """
    r = records
    apn = F.nullif(F.col("apn"), F.lit(""))
    extra = {
        "ParcelNumber": F.coalesce(apn, F.concat(F.lit(NO_PARCEL_PREFIX), F.col("source"), F.lit("-"), F.col("listing_key"))),
        "ListingKey": F.concat(F.col("source"), F.lit("_"), F.col("listing_key")),
        "UnparsedAddress": F.col("address"),
        "PostalCode": F.col("postal_code"),
        "PropertyType": F.col("property_type"),
        "ListPrice": F.col("list_price"),
        "TaxAnnualAmount": F.col("annual_property_tax"),
        "MonthlyHOAAmt": F.col("monthly_hoa"),
        "BedroomsTotal": F.col("beds"),
        "BathroomsTotal": F.col("baths"),
        "LivingArea": F.col("sqft"),
        "search_url": F.col("search_url") if "search_url" in r.columns else F.lit(None).cast("string"),
    }
    out = []
    for f in PORTAL_SCHEMA.fields:
        if f.name == "value_estimate":
            out.append(F.coalesce(nullif_zero(F.col("value_estimate")), F.col("list_price")).alias(f.name))
        elif f.name in extra:
            out.append(extra[f.name].cast(f.dataType).alias(f.name))
        else:
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
    return r.select(*keep, *out)


def map_portal(pages: DataFrame, layout: str, source: str | None = None,
               criteria: SearchCriteria | None = None, **kw) -> DataFrame:
    """Saved pages -> bronze rows (records + RESO-style keys)."""
    recs = map_portal_records(pages, layout, source, criteria, **kw)
    fields = {n for n, _ in PORTAL_RECORD_FIELDS}
    return to_bronze(recs, keep=[x for x in recs.columns if x not in fields])


def known_sources(requested: Sequence[str] | None, sources: Mapping[str, str] = DEFAULT_SOURCES) -> list[str]:
    """Requested source names that exist (default: all); unknown ones are logged and skipped."""
    names = list(sources) if requested is None else list(requested)
    out = []
    for n in names:
        if n in sources:
            out.append(n)
        else:
            logger.warning("Unknown source: %s", n)
    return out


def collect_sources(records_by_source: Mapping[str, DataFrame], requested: Sequence[str] | None = None,
                    sources: Mapping[str, str] = DEFAULT_SOURCES) -> DataFrame | None:
    """Union-all of the records of every known requested source."""
    parts = [records_by_source[n] for n in known_sources(requested, sources) if n in records_by_source]
    if not parts:
        return None
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def source_fallback(spark: SparkSession, records: DataFrame | None, requested: Sequence[str] | None = None,
                    criteria: SearchCriteria | None = None,
                    sources: Mapping[str, str] = DEFAULT_SOURCES) -> DataFrame:
    """One search-URL row per known requested source that produced no records.

    The set of sources present is a tiny aggregate (one row per source, partial
    aggregation on the map side); the anti-join runs on that, never on records.
    """
    c = criteria or SearchCriteria()
    names = known_sources(requested, sources)
    want = spark.createDataFrame([(n, sources[n]) for n in names], "source string, layout string")
    if records is not None:
        present = records.select("source").distinct()
        want = want.join(present, "source", "left_anti")
    urls = F.lit(None).cast("string")
    for name in names:
        urls = F.when(F.col("source") == name,
                      search_url_col(sources[name], c.city, c.state, c.beds, c.baths, c.property_type)).otherwise(urls)
    rec = want.select(
        F.col("source"),
        F.concat(F.col("source"), F.lit(FALLBACK_KEY_SUFFIX)).alias("listing_key"),
        F.lit(f"{c.city}, {c.state}").alias("address"),
        F.lit(c.city).alias("city"), F.lit(c.state).alias("state"), F.lit("").alias("postal_code"),
        F.lit(None).cast("double").alias("list_price"), F.lit(c.property_type).alias("property_type"),
        F.lit(int(c.beds)).alias("beds"), F.lit(float(c.baths)).alias("baths"),
        F.lit(None).cast("double").alias("sqft"), F.lit(None).cast("double").alias("lot_sqft"),
        F.lit(None).cast("int").alias("year_built"), F.lit("").alias("url"),
        F.lit(None).cast("double").alias("annual_property_tax"), F.lit(0.0).alias("monthly_hoa"),
        F.lit(False).alias("has_hoa"), F.lit("").alias("apn"), F.lit(None).cast("double").alias("value_estimate"),
        F.lit(FALLBACK_ESTIMATE_SOURCE).alias("estimate_source"),
        urls.alias("search_url"),
    )
    return to_bronze(rec)


def search_filter(df: DataFrame, min_price: float | None = None, max_price: float | None = None,
                  price_col: str = "list_price") -> DataFrame:
    """Price bounds of a search; each bound is off when unset."""
    p = F.col(price_col)
    if min_price is not None:
        df = df.filter(p >= F.lit(float(min_price)))
    if max_price is not None:
        df = df.filter(p <= F.lit(float(max_price)))
    return df


def source_counts(records: DataFrame) -> DataFrame:
    """Records per source (partial counts per task, then one row per source)."""
    return records.groupBy("source").agg(F.count(F.lit(1)).alias("n_records"))


def search(spark: SparkSession, pages_by_source: Mapping[str, DataFrame], criteria: SearchCriteria | None = None,
           requested: Sequence[str] | None = None, sources: Mapping[str, str] = DEFAULT_SOURCES) -> DataFrame:
    """All known requested sources -> bronze rows, plus fallback rows for the
    sources that gave nothing."""
    c = criteria or SearchCriteria()
    recs = {n: map_portal(pages_by_source[n].select("html"), sources[n], n, c)
            for n in known_sources(requested, sources) if n in pages_by_source}
    found = collect_sources(recs, requested, sources)
    fb = source_fallback(spark, found, requested, c, sources)
    return fb if found is None else found.unionByName(fb, allowMissingColumns=True)

