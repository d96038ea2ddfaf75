"""Incremental refresh of silver and gold: only buckets that new rows touch are read and written again.

Five tables under one root, each partitioned by ``bucket`` (a hash of its key):

* ``listings``   latest version of each listing with its version columns, by listing key
* ``parcels``    the same silver rows, by parcel (a listing without one by its own key)
* ``estimates``  latest estimate of each parcel and source with its version columns, by parcel
* ``values``     triangulated values, by parcel
* ``screen``     screen rows without rank, by parcel

The latest of old and new rows is the latest of both latest ones, so a refresh merges the new rows into the buckets
they hash to. Listings whose row changed name the parcels they leave and enter; the parcels' buckets, and those of new
estimates, are triangulated, joined and screened again. Old and new rows of a bucket are written to scratch first and
then replace the bucket's folder (dynamic partition overwrite); a bucket that becomes empty holds one row that is not
``live``, as an overwrite leaves folders alone for which it has no row.

A refresh that stops midway is simply run again with the same rows: ``listings`` is written last, so the changes are found
again, and every other step gives the same rows when repeated. The numbers of touched buckets (at most ``buckets``) are
all that reaches the driver. The global rank is not kept by bucket: one new row may move every other, so it is taken
from the screen and published as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscreen.config import Assumptions, pin
from dealscreen.operators.dedup import dedup_latest, with_order
from dealscreen.operators.screen import SCREEN_COLS, deal_screen
from dealscreen.operators.triangulate import value_triangulation
from dealscreen.plans.silver import estimate_rows, listing_attributes
from dealscreen.schemas import (BRONZE_SCHEMA, ESTIMATE_ORDER, GOLD_TRIANGULATION_COLS, LISTING_ORDER, SILVER_LISTINGS_COLS,
                                SILVER_VALUE_ESTIMATES_COLS, conform)

#: Buckets of each table by default: the tables' size divided by what one task should rewrite.
BUCKETS = 4096
_LIVE = "live"


def parcel_key() -> Column:
    """The parcel of a listing; one without a parcel stands by itself."""
    return F.coalesce(F.col("apn"), F.concat(F.lit("\u0000"), F.col("listing_key")))


@dataclass(frozen=True)
class BucketTable:
    """A table of rows by the hash of ``key``."""

    spark: SparkSession
    path: str
    key: Column
    buckets: int

    def placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def exists(self) -> bool:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket=*")
        return bool(found.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(found))

    def read(self, like: DataFrame | None = None, only: Sequence[int] | None = None) -> DataFrame:
        """Rows of the table, or of the given buckets (folders of others are not listed); none, shaped ``like``, before the first write."""
        if not self.exists():
            if like is None:
                raise ValueError(f"no table at {self.path}")
            return like.limit(0)
        rows = self.spark.read.parquet(self.path)
        if only is not None:
            rows = rows.where(F.col("bucket").isin([int(b) for b in only]) if len(only) else F.lit(False))
        return rows.where(_LIVE).drop(_LIVE)

    def replace(self, rows: DataFrame, touched: Sequence[int]) -> None:
        """The touched buckets' rows become ``rows`` (which must lie in them)."""
        if not len(touched):
            return
        marks = self.spark.createDataFrame([(int(b), False) for b in touched], f"bucket int, {_LIVE} boolean")
        out = rows.withColumn(_LIVE, F.lit(True)).unionByName(marks, allowMissingColumns=True)
        # A bucket's rows meet in one task; a bucket that is too large for one is split by the adaptive plan.
        (out.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("bucket").parquet(self.path))


@dataclass(frozen=True)
class Refreshed:
    """How many buckets of each table a refresh wrote."""

    listings: int
    parcels: int
    estimates: int
    screen: int


class RefreshTables:
    """The five tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        table = lambda name, key: BucketTable(spark, f"{root.rstrip('/')}/{name}", key, buckets)
        self.spark = spark
        self.listings, self.parcels = table("listings", F.col("listing_key")), table("parcels", parcel_key())
        self.estimates, self.values = table("estimates", F.col("apn")), table("values", F.col("apn"))
        self.screen = table("screen", parcel_key())

    def ranked_input(self) -> DataFrame:
        """All screen rows, as ``rank_deals`` takes them."""
        return self.screen.read().select(*SCREEN_COLS)


def _numbers(*bucketed: DataFrame) -> list[int]:
    """The distinct buckets of the frames, at most as many as the tables have."""
    every = bucketed[0].select("bucket")
    for b in bucketed[1:]:
        every = every.union(b.select("bucket"))
    return sorted(r[0] for r in every.distinct().collect())


def _merged(table: BucketTable, new: DataFrame, keys: Sequence[str], order: Sequence[str], touched: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """(old rows, latest of old and new rows) of the touched buckets, the latter written."""
    old = table.read(new, touched)
    new = new.select(*[F.col(f.name).cast(f.dataType) for f in old.schema.fields])
    return old, pin(dedup_latest(old.unionByName(new), keys, order), "refresh")


def refresh(tables: RefreshTables, bronze: DataFrame | None, feeds: Sequence[DataFrame], a: Assumptions | None = None,
            method: str = "exact", listing_order: Sequence[str] = tuple(LISTING_ORDER),
            estimate_order: Sequence[str] = tuple(ESTIMATE_ORDER)) -> Refreshed:
    """Bring the tables up to date with new bronze rows (or None) and new estimates."""
    a = a or Assumptions()
    left: list[int] = []
    listed: list[int] = []
    if bronze is not None:
        rows = conform(bronze, BRONZE_SCHEMA)
        rows = rows.select(*[c.alias(n) for n, c in listing_attributes().items()], *[F.col(c).alias(f"v_{c}") for c in listing_order])
        order = [*(f"v_{c}" for c in listing_order), *(c for c in SILVER_LISTINGS_COLS if c != "listing_key")]
        new = pin(tables.listings.placed(dedup_latest(rows, ["listing_key"], order)), "refresh")
        listed = _numbers(new)
        old, versions = _merged(tables.listings, new, ["listing_key"], order, listed)
        # Rows that differ from those before, with the parcel they leave (if they had one) and the one they enter.
        before = old.select(F.col("listing_key").alias("k"), F.struct(*SILVER_LISTINGS_COLS).alias("was"), parcel_key().alias("from"))
        now = F.struct(*SILVER_LISTINGS_COLS)
        changed = versions.join(before, F.col("listing_key") == F.col("k"), "left").where(F.col("k").isNull() | ~now.eqNullSafe(F.col("was")))
        changed = pin(tables.parcels.placed(changed.select(*SILVER_LISTINGS_COLS, "from")), "refresh")
        sources = changed.where("`from` IS NOT NULL").select(F.pmod(F.xxhash64("from"), F.lit(tables.parcels.buckets)).cast("int").alias("bucket"))
        left = _numbers(changed, sources)
        entered = changed.drop("from")
        kept = tables.parcels.read(entered, left).join(changed.select("listing_key"), "listing_key", "left_anti")
        tables.parcels.replace(pin(kept.unionByName(entered), "refresh"), left)
    priced: list[int] = []
    if feeds:
        rows = dedup_latest(estimate_rows(feeds, estimate_order), ["apn", "estimate_source"], [*estimate_order, "value_estimate"])
        rows = rows.select(*SILVER_VALUE_ESTIMATES_COLS, *[F.col(c).alias(f"v_{c}") for c in estimate_order])
        new = pin(tables.estimates.placed(rows), "refresh")
        priced = _numbers(new)
        _, latest = _merged(tables.estimates, new, ["apn", "estimate_source"], [*(f"v_{c}" for c in estimate_order), "value_estimate"], priced)
        tables.estimates.replace(latest, priced)
        tables.values.replace(tables.values.placed(value_triangulation(latest, method, a)), priced)
    touched = sorted({*left, *priced})
    if touched and tables.parcels.exists():
        no_values = tables.spark.createDataFrame([], "apn string, value_estimate double, n_sources long, spread_pct double, value_confidence string")
        values = tables.values.read(tables.values.placed(no_values), touched).select(*GOLD_TRIANGULATION_COLS)
        screen = deal_screen(tables.parcels.read(None, touched).select(*SILVER_LISTINGS_COLS), values, a)
        tables.screen.replace(tables.screen.placed(screen), touched)
    if listed:
        tables.listings.replace(versions, listed)
    return Refreshed(len(listed), len(left), len(priced), len(touched))
