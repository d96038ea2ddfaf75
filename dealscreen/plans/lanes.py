"""Both lanes from one input: rows are routed by where they come from, and each lane's tables lie in its own database.

Listings and estimates are tagged once (``lane``) and written partitioned by it; a lane's run reads only its partition.
Every table of a run is written to the lane's database after a check that the rows are that lane's (``run_pipeline``), so
no public source reaches the licensed tables, nor a licensed one the public tables. Estimates that portal rows carry
themselves follow their rows. Rows of unknown origin are licensed: the lane that is not given away.

The inputs are independent of each other, and so are the lanes: they are written at the same time, so that cores that one
job leaves idle (few tasks, the last ones, commits) are the other's.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscreen.config import LICENSED, PUBLIC, Assumptions, Namespace, ensure_namespace, lane_column, scratch_path
from dealscreen.plans.pipeline import run_pipeline
from dealscreen.plans.silver import own_estimates
from dealscreen.schemas import BRONZE_SCHEMA, ESTIMATE_ORDER, LISTING_ORDER, conform

# Listing sources that are public (portals); all others are licensed.
PUBLIC_LISTING_SOURCES = ("portal_a", "portal_b", "portal_c")


def route(df: DataFrame, source_col: str, public_sources: Sequence[str], name: str) -> DataFrame:
    """The rows with their ``lane``, written once, partitioned by it."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    tagged = df.withColumn("lane", lane_column(source_col, tuple(public_sources)))
    tagged.write.partitionBy("lane").parquet(path)
    return spark.read.schema(tagged.schema).parquet(path)


def _together(spark: SparkSession, runs: Sequence[Callable]) -> list:
    """The results of independent runs, at the same time; all have ended when the first error is raised."""
    with ThreadPoolExecutor(len(runs)) as pool:
        futures = [pool.submit(inheritable_thread_target(spark)(run)) for run in runs]
    return [f.result() for f in futures]


def run_lanes(spark: SparkSession, bronze: DataFrame, estimate_feeds: Sequence[DataFrame], ns: Namespace | None = None,
              a: Assumptions | None = None, method: str = "exact", listing_order: Sequence[str] = tuple(LISTING_ORDER),
              estimate_order: Sequence[str] = tuple(ESTIMATE_ORDER), location_root: str | None = None,
              public_listing_sources: Sequence[str] = PUBLIC_LISTING_SOURCES, public_estimate_sources: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Every layer of both lanes; the ranked table by lane."""
    from dealscreen.config import PUBLIC_SOURCES

    sources = PUBLIC_SOURCES if public_estimate_sources is None else public_estimate_sources
    ns = ns or Namespace.from_spark(spark)
    ensure_namespace(spark, ns, location_root)
    listings, *feeds = _together(spark, [
        lambda: route(conform(bronze, BRONZE_SCHEMA), "source", public_listing_sources, "lane-bronze"),
        *[lambda f=f: route(f, "estimate_source", sources, "lane-feed") for f in estimate_feeds]])

    def run(lane: str) -> DataFrame:
        mine = listings.where(F.col("lane") == lane)
        own = own_estimates(mine).withColumn("lane", F.lit(lane))
        given = [f.where(F.col("lane") == lane) for f in feeds]
        return run_pipeline(spark, mine, [*given, own], ns=ns, a=a, method=method, location_root=location_root,
                            listing_order=listing_order, estimate_order=estimate_order, lane=lane, feeds_written=True)

    lanes = (LICENSED, PUBLIC)
    return dict(zip(lanes, _together(spark, [lambda lane=lane: run(lane) for lane in lanes])))
