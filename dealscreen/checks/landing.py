"""Checks of landing files, result envelopes, incremental pulls and the
bronze stream. Each check writes into a fresh folder under the session's
shared checkpoint directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealscreen import fixtures as fx
from dealscreen import oracle_sql as osql
from dealscreen.checks import register
from dealscreen.checks.core import bronze
from dealscreen.config import scratch_path
from dealscreen.schemas import BRONZE_SCHEMA, CORRUPT_COL, conform
from dealscreen.sources import files
from dealscreen.sources import incremental as inc
from dealscreen.streaming.bronze import run_bronze

BRONZE_COLS = [f.name for f in BRONZE_SCHEMA.fields]
_BRONZE_SQL_COLS = ", ".join(
    f"CAST(NULL AS VARCHAR) AS {n}" if n in ("City", "State", "search_url", "estimate_source")
    else ("CAST(NULL AS DOUBLE) AS value_estimate" if n == "value_estimate" else n)
    for n in BRONZE_COLS)

# --------------------------------------------------------------------------- #
# Paged result envelopes
# --------------------------------------------------------------------------- #
ENVELOPE_RECORD = T.StructType([
    T.StructField("ListingKey", T.StringType()), T.StructField("ListPrice", T.DoubleType()),
    T.StructField("ModificationTimestamp", T.TimestampNTZType()), T.StructField("seq", T.LongType()),
])


def _envelopes(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "pages")
    fx.envelope_pages(spark, sf).select("body").write.text(path)
    return files.read_page_envelopes(spark, path, ENVELOPE_RECORD)


register("page_envelope_flatten", osql.with_base() + f"""
SELECT ListingKey, ListPrice, ModificationTimestamp, seq FROM fx_bronze
WHERE CAST(floor(seq / {fx.ROWS_PER_ENVELOPE}) AS BIGINT) % 5 <> 4""")(_envelopes)

register("page_envelope_inline", osql.with_base() + f"""
SELECT ListingKey, ListPrice, ModificationTimestamp, seq FROM fx_bronze
WHERE CAST(floor(seq / {fx.ROWS_PER_ENVELOPE}) AS BIGINT) % 5 <> 4""")(
    lambda spark, sf: files.flatten_envelopes(fx.envelope_pages(spark, sf), ENVELOPE_RECORD))


# Truncated pages: every fourth page (from 1) lost its end; its text is kept aside, the others' records arrive.
CUT_RULE = "page % 4 = 1"


def _broken_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = fx.envelope_pages(spark, sf).selectExpr(
        "page", f"CASE WHEN {CUT_RULE} THEN substring(body, 1, length(body) - 30) ELSE body END AS body")
    held = files.quarantined_envelopes(pages, ENVELOPE_RECORD).select(F.lit("page").alias("kind"), F.lit(1).alias("x"))
    good = files.flatten_envelopes(pages, ENVELOPE_RECORD).select(F.lit("record").alias("kind"), F.lit(1).alias("x"))
    return held.union(good).groupBy("kind").agg(F.count("x").alias("n"))


register("page_envelope_quarantine", osql.with_base() + f"""
SELECT kind, count(*) AS n FROM (
  SELECT DISTINCT 'page' AS kind, page FROM (SELECT CAST(floor(seq / {fx.ROWS_PER_ENVELOPE}) AS BIGINT) AS page FROM fx_bronze) p
  WHERE {CUT_RULE}
  UNION ALL
  SELECT 'record', page FROM (SELECT CAST(floor(seq / {fx.ROWS_PER_ENVELOPE}) AS BIGINT) AS page FROM fx_bronze) p
  WHERE NOT ({CUT_RULE}) AND page % 5 <> 4) x
GROUP BY kind""")(_broken_pages)

# --------------------------------------------------------------------------- #
# Landing sink and dry run
# --------------------------------------------------------------------------- #


def _roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    landing = scratch_path(spark, "landing")
    files.write_landing(conform(bronze(spark, sf), BRONZE_SCHEMA), landing, "listings")
    return files.good_rows(files.read_bronze(spark, landing)).select(*BRONZE_COLS)


register("landing_roundtrip", osql.with_base() + f"\nSELECT {_BRONZE_SQL_COLS} FROM fx_bronze")(_roundtrip)


def _dry_run(spark: SparkSession, sf: str) -> DataFrame:
    landing = scratch_path(spark, "landing-dry")
    return files.write_landing(bronze(spark, sf), landing, "listings", dry_run=True)


register("landing_dry_run_count", osql.with_base() + "\nSELECT count(*) AS n_records FROM fx_bronze")(_dry_run)

# --------------------------------------------------------------------------- #
# Incremental pulls
# --------------------------------------------------------------------------- #
# Fixed value: the stored high-water mark the pull check starts from.
PULL_SINCE = "1999-01-01 00:00:00"
PULL_SELECT = ["ListingKey", "ListPrice", "seq"]


def _pull(spark: SparkSession, sf: str) -> DataFrame:
    import datetime as dt

    root = scratch_path(spark, "pull")
    state, landing = f"{root}/_state", f"{root}/landing"
    inc.write_watermark(spark, state, dt.datetime.fromisoformat(PULL_SINCE))
    src = bronze(spark, sf)
    res = inc.incremental_pull(src, landing, state, select=PULL_SELECT)
    schema = src.select(*PULL_SELECT, inc.TS_COL).schema
    return spark.read.schema(schema).json(res.batch_path)


register("incremental_pull", osql.with_base() + f"""
SELECT ListingKey, ListPrice, seq, ModificationTimestamp FROM fx_bronze
WHERE ModificationTimestamp > TIMESTAMP '{PULL_SINCE}'""")(_pull)


def _state(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "pull-state")
    state, landing = f"{root}/_state", f"{root}/landing"
    src = bronze(spark, sf)
    first = inc.incremental_pull(src, landing, state, select=PULL_SELECT)       # no watermark: everything
    second = inc.incremental_pull(src, landing, state, select=PULL_SELECT)      # nothing newer
    dry = inc.incremental_pull(src, landing, state, select=PULL_SELECT, inclusive=True, dry_run=True)
    return spark.read.parquet(state).agg(F.max("watermark").alias("watermark")).select(
        "watermark", F.lit(first.n_records).cast("bigint").alias("n_first"),
        F.lit(second.n_records).cast("bigint").alias("n_second"),
        F.lit(dry.n_records).cast("bigint").alias("n_inclusive_dry_run"))


# Times with microseconds: a second pull finds nothing newer, and the landed text keeps them.
_MICRO = "ModificationTimestamp + make_dt_interval(0, 0, 0, 0.000001 * (seq % 999983 + 1))"


def _micro(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "pull-micro")
    state, landing = f"{root}/_state", f"{root}/landing"
    src = bronze(spark, sf).select("ListingKey", "seq", F.expr(_MICRO).alias(inc.TS_COL))
    first = inc.incremental_pull(src, landing, state)
    second = inc.incremental_pull(src, landing, state)
    return spark.read.schema(src.schema).json(first.batch_path).agg(
        F.count(F.lit(1)).alias("n_first"), F.max(inc.TS_COL).alias("watermark"),
        F.sum(F.date_format(inc.TS_COL, "SSSSSS").cast("bigint")).alias("sum_micros")).withColumn(
        "n_second", F.lit(second.n_records).cast("bigint"))


register("incremental_micros", osql.with_base() + """
SELECT count(*) AS n_first, max(ModificationTimestamp + to_microseconds(seq % 999983 + 1)) AS watermark,
  CAST(sum(seq % 999983 + 1) AS BIGINT) AS sum_micros, CAST(0 AS BIGINT) AS n_second FROM fx_bronze""")(_micro)

register("incremental_state", osql.with_base() + """
SELECT max(ModificationTimestamp) AS watermark, count(*) AS n_first, CAST(0 AS BIGINT) AS n_second,
  CAST(count(*) FILTER (WHERE ModificationTimestamp = (SELECT max(ModificationTimestamp) FROM fx_bronze)) AS BIGINT)
    AS n_inclusive_dry_run
FROM fx_bronze""")(_state)

# --------------------------------------------------------------------------- #
# Bronze stream: batches land over time, the stream picks up each file once
# --------------------------------------------------------------------------- #
# The landing slices (by modification year) of the stream check.
STREAM_SLICES = ["year(ModificationTimestamp) < 1997", "year(ModificationTimestamp) BETWEEN 1997 AND 1998",
                 "year(ModificationTimestamp) > 1998"]


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    root = scratch_path(spark, "stream")
    landing, ckpt, out = f"{root}/landing", f"{root}/_checkpoint", f"{root}/bronze"
    b = conform(bronze(spark, sf), BRONZE_SCHEMA)
    files.write_landing(b.filter(STREAM_SLICES[0]), landing, "listings", label="s0")
    spark.createDataFrame([("1999-01-01T00:00:00Z",)], "w string").coalesce(1).write.text(f"{landing}/_watermark")
    run_bronze(spark, landing, ckpt, target_path=out)
    for i, cond in enumerate(STREAM_SLICES[1:], 1):
        files.write_landing(b.filter(cond), landing, "listings", label=f"s{i}")
    run_bronze(spark, landing, ckpt, target_path=out)
    run_bronze(spark, landing, ckpt, target_path=out)  # nothing new: exactly once
    return files.good_rows(spark.read.parquet(out)).select(*BRONZE_COLS)


register("bronze_stream", osql.with_base() + f"\nSELECT {_BRONZE_SQL_COLS} FROM fx_bronze")(_stream)


# Corrupt lines: every 101st listing version is landed as truncated JSON.
def _quarantine(spark: SparkSession, sf: str) -> DataFrame:
    landing = scratch_path(spark, "landing-bad")
    b = conform(bronze(spark, sf), BRONZE_SCHEMA)
    text = F.to_json(F.struct(*[F.col(c) for c in BRONZE_COLS]))
    lines = b.select(F.when(F.col("seq") % 101 == 0, F.substring(text, 1, 25)).otherwise(text).alias("value"))
    lines.write.text(f"{landing}/listings_bad")
    df = files.read_bronze(spark, landing)
    return df.agg(
        F.count(F.when(F.col(CORRUPT_COL).isNotNull(), 1)).alias("n_corrupt"),
        F.count(F.when(F.col(CORRUPT_COL).isNull() & F.col("ListingKey").isNotNull(), 1)).alias("n_good"))


register("bronze_quarantine", osql.with_base() + """
SELECT count(*) FILTER (WHERE seq % 101 = 0) AS n_corrupt, count(*) FILTER (WHERE seq % 101 <> 0) AS n_good
FROM fx_bronze""")(_quarantine)


def _scheduled_run(spark: SparkSession, sf: str) -> DataFrame:
    import uuid

    from dealscreen.config import Namespace
    from dealscreen.plans.pipeline import run_from_landing

    root = scratch_path(spark, "scheduled")
    landing = f"{root}/landing"
    b = conform(bronze(spark, sf), BRONZE_SCHEMA)
    for i, cond in enumerate(STREAM_SLICES):
        files.write_landing(b.filter(cond), landing, "listings", label=f"s{i}")
    feeds = [fx.estimate_feed(spark, sf)]
    return run_from_landing(spark, landing, feeds, f"{root}/_checkpoint", f"{root}/bronze",
                            estimate_order=fx.ESTIMATE_ORDER, ns=Namespace(tenant=f"sched_{uuid.uuid4().hex[:8]}"),
                            location_root=f"{root}/warehouse")


register("scheduled_run_from_landing", osql.gold_ctes() + "\nSELECT * FROM gold")(_scheduled_run)


def _listing_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Listings without a key and estimates without parcel, value or source are set aside, none is lost."""
    from dealscreen.plans.silver import quarantined_estimates, quarantined_listings

    b = bronze(spark, sf).withColumn("ListingKey", F.expr("CASE WHEN seq % 17 <> 0 THEN ListingKey END"))
    e = fx.estimate_feed(spark, sf).withColumn(
        "estimate_source", F.expr("CASE WHEN l_orderkey % 19 <> 0 THEN estimate_source END"))
    return (quarantined_listings(b).select(F.lit("listing").alias("kind"))
            .union(quarantined_estimates([e]).select(F.lit("estimate"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))


register("listing_quarantine", osql.with_base() + f"""
SELECT kind, count(*) AS n FROM (
  SELECT 'listing' AS kind FROM fx_bronze WHERE seq % 17 = 0
  UNION ALL
  SELECT 'estimate' FROM fx_estimates WHERE l_orderkey % 19 = 0 OR {osql.apn('ParcelNumber')} IS NULL
    OR value_estimate IS NULL OR estimate_source IS NULL) x
GROUP BY kind""")(_listing_quarantine)


def _mls_list(spark: SparkSession, sf: str) -> DataFrame:
    """The listings' own prices as estimates, latest per parcel, in a feed that has nothing but its own columns."""
    from dealscreen.plans.silver import mls_list_estimates, silver_value_estimates

    return silver_value_estimates([mls_list_estimates(bronze(spark, sf))])


register("mls_list_estimates", osql.with_base() + f"""
SELECT apn, value_estimate, estimate_source FROM (
  SELECT {osql.apn('ParcelNumber')} AS apn, ListPrice AS value_estimate, 'mls_list' AS estimate_source,
    row_number() OVER (PARTITION BY {osql.apn('ParcelNumber')} ORDER BY ModificationTimestamp DESC NULLS LAST,
      seq DESC NULLS LAST) AS rn
  FROM fx_bronze WHERE {osql.apn('ParcelNumber')} IS NOT NULL AND ListPrice IS NOT NULL) x
WHERE rn = 1""")(_mls_list)


def _resumable(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of a twentieth of the rows, a stop between two of them, and half the rows of the mark's instant arriving later."""
    from dealscreen.sources.resumable import resumable_pull

    root = scratch_path(spark, "resumable")
    src = bronze(spark, sf)
    n, instant = src.agg(F.count(F.lit(1)), F.max(F.when(F.col(inc.TS_COL) < F.lit(PULL_SINCE).cast("timestamp_ntz"), F.col(inc.TS_COL)))).first()
    at = F.col(inc.TS_COL) == F.lit(instant)
    early = src.where((F.col(inc.TS_COL) < F.lit(instant)) | (at & (F.col("seq") % 2 == 0)))
    how = {"key_col": "seq", "batch_rows": max(1, n // 5), "select": PULL_SELECT}
    resumable_pull(early, f"{root}/landing", f"{root}/_state", max_batches=2, **how)
    resumable_pull(early, f"{root}/landing", f"{root}/_state", **how)
    resumable_pull(early, f"{root}/landing", f"{root}/_state", **how)  # nothing new
    resumable_pull(src, f"{root}/landing", f"{root}/_state", **how)
    schema = src.select(*PULL_SELECT, inc.TS_COL).schema
    return spark.read.option("recursiveFileLookup", "true").schema(schema).json(f"{root}/landing")


register("incremental_resumable", osql.with_base()
         + "\nSELECT ListingKey, ListPrice, seq, ModificationTimestamp FROM fx_bronze")(_resumable)


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    """Two landings, some lines cut; the second batch's first attempt fails between its two tables and is replayed."""
    from dealscreen.streaming import routed

    root = scratch_path(spark, "routed")
    b = conform(bronze(spark, sf), BRONZE_SCHEMA)
    text = F.to_json(F.struct(*[F.col(c) for c in BRONZE_COLS]))
    lines = b.select("seq", F.when(F.col("seq") % 101 == 0, F.substring(text, 1, 25)).otherwise(text).alias("value"))
    failures = [1]

    def move(spark, source, target):
        if "quarantine" in target and "batch=1" in target and failures:
            failures.pop()
            raise RuntimeError("stopped between the two tables")
        routed._move(spark, source, target)

    for i in range(2):
        lines.where(F.col("seq") % 2 == i).select("value").write.text(f"{root}/landing/listings_{i}")
        for _ in range(2):
            try:
                routed.run_routed(spark, f"{root}/landing", f"{root}/_checkpoint", root, move=move)
                break
            except Exception:  # the stream reports the stop; the next run replays the batch
                if i == 0 or failures:
                    raise
    good = routed.routed_table(spark, root, "bronze").select(F.lit("bronze").alias("sink"), "ListingKey", "seq")
    bad = routed.routed_table(spark, root, "quarantine").select(F.lit("quarantine").alias("sink"), F.lit(None).cast("string"), F.lit(None).cast("long"))
    return good.union(bad).groupBy("sink").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("seq"), F.lit(0)).alias("sum_seq"),
                                              F.count_distinct("seq").alias("n_seq"))


register("bronze_routed", osql.with_base() + """
SELECT 'bronze' AS sink, count(*) AS n, CAST(sum(seq) AS BIGINT) AS sum_seq, count(DISTINCT seq) AS n_seq FROM fx_bronze WHERE seq % 101 <> 0
UNION ALL
SELECT 'quarantine', count(*), 0, 0 FROM fx_bronze WHERE seq % 101 = 0 HAVING count(*) > 0""")(_routed)
