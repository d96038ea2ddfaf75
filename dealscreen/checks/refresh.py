"""Checks of incremental refreshes and published snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscreen import fixtures as fx
from dealscreen import oracle_sql as osql
from dealscreen.checks import register
from dealscreen.checks.core import bronze
from dealscreen.checks.landing import STREAM_SLICES
from dealscreen.config import Namespace, ensure_namespace, pin, scratch_path
from dealscreen.operators.publish import publish
from dealscreen.operators.rank import rank_deals
from dealscreen.plans.refresh import RefreshTables, refresh
from dealscreen.schemas import GOLD_DEAL_SCREEN_COLS, GOLD_TRIANGULATION_COLS

# How the estimate feed arrives, in three parts.
ESTIMATE_SLICES = ["year(as_of) < 1996", "year(as_of) BETWEEN 1996 AND 1997", "year(as_of) > 1997"]


def _refreshed(spark: SparkSession, sf: str, listings: bool = True) -> RefreshTables:
    """Three landings of listings and estimates, of which the last one is older than the second."""
    tables = RefreshTables(spark, scratch_path(spark, "refresh"), buckets=8)
    # Every landing reads its slice of both: the adapter's join runs once, not once a landing.
    b = pin(bronze(spark, sf), "refresh-input") if listings else None
    e = pin(fx.estimate_feed(spark, sf), "refresh-input")
    for i in (0, 2, 1):
        refresh(tables, b.where(STREAM_SLICES[i]) if listings else None, [e.where(ESTIMATE_SLICES[i])], estimate_order=fx.ESTIMATE_ORDER)
    return tables


register("refresh_screen", osql.gold_ctes() + "\nSELECT * FROM gold")(
    lambda spark, sf: rank_deals(_refreshed(spark, sf).ranked_input()).select(*GOLD_DEAL_SCREEN_COLS))

register("refresh_values", osql.with_base(osql.silver_estimates_cte(), osql.triangulation_cte()) + "\nSELECT * FROM tri")(
    lambda spark, sf: _refreshed(spark, sf, listings=False).values.read().select(*GOLD_TRIANGULATION_COLS))


def _published(spark: SparkSession, sf: str) -> DataFrame:
    """A served table is replaced while a reader is open; the reader's rows and the table's are told apart."""
    ns = Namespace(tenant=f"pub_{uuid.uuid4().hex[:8]}")
    ensure_namespace(spark, ns, scratch_path(spark, "warehouse"))
    table, rows = ns.licensed("served"), bronze(spark, sf).select("ListingKey", "ListPrice", "seq")
    reader = publish(rows.where("seq % 3 <> 0"), table)
    now = publish(rows.where("seq % 2 = 0"), table)
    return reader.withColumn("seen_by", F.lit("reader")).unionByName(now.withColumn("seen_by", F.lit("table")))


register("publish_snapshots", osql.with_base() + """
SELECT ListingKey, ListPrice, seq, 'reader' AS seen_by FROM fx_bronze WHERE seq % 3 <> 0
UNION ALL
SELECT ListingKey, ListPrice, seq, 'table' FROM fx_bronze WHERE seq % 2 = 0""")(_published)


# The parcels that are looked up, by the adapter's naming of the first hundred, and one that doesn't exist.
LOOKUPS = [*(f"{pid:06d}AB{pid % 7}" for pid in range(1, 101)), "NOWHERE1"]


def _lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The best deal of each of some parcels, from the key-ordered layout of all ranked rows."""
    from dealscreen.checks.core import gold
    from dealscreen.operators.lookup import lookup, write_lookup

    path = scratch_path(spark, "lookup")
    write_lookup(gold(spark, sf), path)
    return lookup(spark, path, LOOKUPS)


register("deal_lookup", osql.gold_ctes() + f"""
SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY apn ORDER BY rank_score) AS n FROM gold) x
WHERE n = 1 AND apn IN ({', '.join(f"'{x}'" for x in LOOKUPS)})""")(_lookup)


def _value_state(spark: SparkSession, sf: str) -> DataFrame:
    """States of three landings, merged; the median's rank is held against all estimates."""
    from dealscreen.operators.value_state import RANK_ERROR, merge_states, state_values, value_state
    from dealscreen.plans.silver import estimate_rows

    rows = estimate_rows([fx.estimate_feed(spark, sf)], ["as_of"])
    state = merge_states(*[value_state(rows.where(s)) for s in ESTIMATE_SLICES])
    values = state_values(state).withColumnRenamed("value_estimate", "mid")
    ranks = rows.where("value_estimate > 0").join(values.select("apn", "mid"), "apn").groupBy("apn").agg(
        F.count(F.when(F.col("value_estimate") < F.col("mid"), 1)).alias("less"), F.count(F.when(F.col("value_estimate") <= F.col("mid"), 1)).alias("upto"))
    slack = F.col("n") * F.lit(RANK_ERROR) + F.lit(1.0)
    return state.join(values.select("apn", "n_sources", "mid"), "apn").join(ranks, "apn").select(
        "apn", "n", "low", "high", "n_sources", F.array_join("sources", ",").alias("sources"),
        ((F.col("less") <= F.col("n") * 0.5 + slack) & (F.col("upto") >= F.col("n") * 0.5 - slack)).alias("within_bound"))


register("value_state_merged", osql.with_base() + f"""
SELECT apn, count(*) AS n, min(value_estimate) AS low, max(value_estimate) AS high, count(DISTINCT estimate_source) AS n_sources,
  array_to_string(list_sort(list(DISTINCT estimate_source)), ',') AS sources, true AS within_bound
FROM (SELECT {osql.apn('ParcelNumber')} AS apn, value_estimate, estimate_source, as_of FROM fx_estimates) e
WHERE apn IS NOT NULL AND value_estimate > 0 AND as_of IS NOT NULL GROUP BY apn""")(_value_state)


def _lane_tables(spark: SparkSession, sf: str) -> DataFrame:
    """The ranked tables of both lanes; portal rows bring their own estimates."""
    from dealscreen.plans.lanes import run_lanes

    b = bronze(spark, sf).withColumn("value_estimate", F.expr(f"CASE WHEN source <> 'reso' THEN {fx.OWN_ESTIMATE} END")).withColumn(
        "estimate_source", F.lit("public_search"))
    ranked = run_lanes(spark, b, [fx.estimate_feed(spark, sf)], ns=Namespace(tenant=f"lane_{uuid.uuid4().hex[:8]}"),
                       estimate_order=fx.ESTIMATE_ORDER, location_root=scratch_path(spark, "warehouse"))
    parts = [df.withColumn("lane", F.lit(lane)) for lane, df in ranked.items()]
    return parts[0].unionByName(parts[1])


def _lane_sql(lane: str) -> str:
    rows = "source = 'reso'" if lane == "licensed" else "source <> 'reso'"
    sources = "estimate_source <> 'county'" if lane == "licensed" else "estimate_source = 'county'"
    own = f"CASE WHEN source <> 'reso' THEN {fx.OWN_ESTIMATE} END"
    estimates = f"""silver_value_estimates AS (
  SELECT apn, value_estimate, estimate_source FROM (
    SELECT *, row_number() OVER (PARTITION BY apn, estimate_source ORDER BY as_of DESC NULLS LAST, l_orderkey DESC NULLS LAST,
        l_linenumber DESC NULLS LAST, l_partkey DESC NULLS LAST, l_suppkey DESC NULLS LAST, value_estimate DESC NULLS LAST) AS rn
    FROM (SELECT {osql.apn('ParcelNumber')} AS apn, value_estimate, estimate_source, as_of, l_orderkey, l_linenumber, l_partkey, l_suppkey
          FROM fx_estimates WHERE {sources}
          UNION ALL
          SELECT {osql.apn('ParcelNumber')}, {own}, 'public_search', ModificationTimestamp, NULL, NULL, NULL, NULL FROM fx_bronze WHERE {rows}) e
    WHERE apn IS NOT NULL AND value_estimate IS NOT NULL) x
  WHERE rn = 1
)"""
    text = osql.gold_ctes().replace(osql.silver_estimates_cte(), estimates)
    text = text.replace("FROM fx_bronze WHERE ListingKey IS NOT NULL", f"FROM fx_bronze WHERE {rows} AND ListingKey IS NOT NULL")
    return f"SELECT '{lane}' AS lane, * FROM ({text}\nSELECT * FROM gold) {lane}_rows"


register("lane_tables", _lane_sql("licensed") + "\nUNION ALL\n" + _lane_sql("public"))(_lane_tables)


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of every table that a run wrote, read back by its qualified name."""
    from dealscreen.config import LICENSED
    from dealscreen.plans.pipeline import run_pipeline

    ns = Namespace(tenant=f"cat_{uuid.uuid4().hex[:8]}")
    b = bronze(spark, sf)
    run_pipeline(spark, b, [fx.estimate_feed(spark, sf, b)], ns=ns, estimate_order=fx.ESTIMATE_ORDER, location_root=scratch_path(spark, "warehouse"))
    prefix = f"{ns.tenant}_"
    names = sorted(t.name.removeprefix(prefix) for t in spark.catalog.listTables(ns.licensed_catalog) if t.name.startswith(prefix))
    parts = [ns.read(spark, LICENSED, n).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


register("catalog_tables", osql.gold_ctes() + f"""
SELECT 'bronze_listings' AS table_name, count(*) AS n_rows FROM fx_bronze
UNION ALL SELECT 'silver_listings', count(*) FROM silver_listings
UNION ALL SELECT 'silver_ml_features', count(*) FROM silver_listings
UNION ALL SELECT 'silver_value_estimates', count(*) FROM silver_value_estimates
UNION ALL SELECT 'gold_value_triangulation', count(*) FROM tri
UNION ALL SELECT 'gold_deal_screen', count(*) FROM gold
UNION ALL SELECT 'gold_ranked', count(*) FROM gold
UNION ALL SELECT 'quarantine_listings', count(*) FROM fx_bronze WHERE ListingKey IS NULL
UNION ALL SELECT 'quarantine_estimates', count(*) FROM fx_estimates
  WHERE {osql.apn('ParcelNumber')} IS NULL OR value_estimate IS NULL OR estimate_source IS NULL""")(_catalog)
