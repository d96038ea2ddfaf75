"""End-to-end run: bronze -> silver -> ML features -> gold -> ranked.

Each layer is written as a table (full overwrite, like a materialized view)
and the next layer reads the written table back, so lineage is cut at every
layer and a lost executor only recomputes the current layer.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from dealscreen.config import LICENSED, Assumptions, Namespace, assert_single_lane, ensure_namespace, pin
from dealscreen.operators.rank import rank
from dealscreen.plans.gold import gold_deal_screen, gold_value_triangulation
from dealscreen.plans.ml_features import ml_features
from dealscreen.plans.silver import (own_estimates, quarantined_estimates, quarantined_listings, silver_listings,
                                     silver_value_estimates)
from dealscreen.schemas import (ESTIMATE_ORDER, GOLD_DEAL_SCREEN_SCHEMA, GOLD_TRIANGULATION_SCHEMA, LISTING_ORDER, ML_SCHEMA,
                                SILVER_LISTINGS_SCHEMA, SILVER_VALUE_ESTIMATES_SCHEMA, enforce)


@dataclass(frozen=True)
class PipelineTables:
    bronze: str
    silver_listings: str
    silver_value_estimates: str
    silver_ml_features: str
    gold_value_triangulation: str
    gold_deal_screen: str
    gold_ranked: str
    quarantine_listings: str
    quarantine_estimates: str
    quarantine_lines: str

    @classmethod
    def of(cls, ns: Namespace, lane: str) -> "PipelineTables":
        """The tables of a lane, in its database."""
        return cls(*(ns.qualified(lane, t) for t in (
            "bronze_listings", "silver_listings", "silver_value_estimates", "silver_ml_features",
            "gold_value_triangulation", "gold_deal_screen", "gold_ranked", "quarantine_listings",
            "quarantine_estimates", "quarantine_lines")))

    @classmethod
    def licensed(cls, ns: Namespace) -> "PipelineTables":
        return cls.of(ns, LICENSED)


def _overwrite(df: DataFrame, table: str) -> DataFrame:
    df.write.mode("overwrite").format("parquet").saveAsTable(table)
    return df.sparkSession.read.table(table)


def _of_lane(df: DataFrame, lane: str) -> DataFrame:
    """Input rows of one lane: rows that are tagged must be that lane's."""
    return assert_single_lane(df, lane) if "lane" in df.columns else df


def _pinned_feed(feed: DataFrame, order: Sequence[str]) -> DataFrame:
    """An estimate feed's columns that the run needs, written once: what makes the feed runs once however often it is read."""
    cols = ["ParcelNumber", "value_estimate", "estimate_source", *order, "lane"]
    return pin(feed.select(*[c for c in cols if c in feed.columns]), "estimate-feed")


def run_pipeline(spark: SparkSession, bronze: DataFrame, estimate_feeds: Sequence[DataFrame],
                 ns: Namespace | None = None, a: Assumptions | None = None, method: str = "exact",
                 model_path: str | None = None, location_root: str | None = None,
                 listing_order: Sequence[str] = tuple(LISTING_ORDER),
                 estimate_order: Sequence[str] = tuple(ESTIMATE_ORDER), bronze_written: bool = False,
                 lane: str = LICENSED, feeds_written: bool = False) -> DataFrame:
    """Run every layer in order and return the ranked gold table.

    Listings without a key and estimates without parcel, value or source are
    written to quarantine tables. With ``bronze_written`` the bronze rows are
    already durable (the stream's table) and are read where they are; so are the
    estimate feeds with ``feeds_written``, otherwise each is written once. All tables
    lie in the lane's database; inputs with a ``lane`` column must be of that lane.
    """
    ns = ns or Namespace.from_spark(spark)
    a = a or Assumptions.from_spark(spark)
    ensure_namespace(spark, ns, location_root)
    t = PipelineTables.of(ns, lane)
    if not feeds_written:
        estimate_feeds = [_pinned_feed(f, estimate_order) for f in estimate_feeds]
    bronze, estimate_feeds = _of_lane(bronze, lane), [_of_lane(f, lane) for f in estimate_feeds]

    b = bronze if bronze_written else _overwrite(bronze, t.bronze)
    _overwrite(quarantined_listings(b), t.quarantine_listings)
    _overwrite(quarantined_estimates(list(estimate_feeds)), t.quarantine_estimates)
    listings = _overwrite(enforce(silver_listings(b, listing_order), "silver_listings", SILVER_LISTINGS_SCHEMA), t.silver_listings)
    estimates = silver_value_estimates(list(estimate_feeds), estimate_order)
    estimates = _overwrite(enforce(estimates, "silver_value_estimates", SILVER_VALUE_ESTIMATES_SCHEMA), t.silver_value_estimates)
    values = gold_value_triangulation(estimates, method, a)
    values = _overwrite(enforce(values, "gold_value_triangulation", GOLD_TRIANGULATION_SCHEMA), t.gold_value_triangulation)
    _overwrite(enforce(ml_features(b, values, a, tuple(listing_order)), "silver_ml_features", ML_SCHEMA), t.silver_ml_features)
    screen = _overwrite(enforce(gold_deal_screen(listings, values, a), "gold_deal_screen", GOLD_DEAL_SCREEN_SCHEMA), t.gold_deal_screen)
    return rank(screen, model_path=model_path, target=t.gold_ranked)


def run_from_landing(spark: SparkSession, landing: str, estimate_feeds: Sequence[DataFrame], checkpoint: str,
                     bronze_path: str, max_files_per_trigger: int | None = None, **kw) -> DataFrame:
    """Scheduled run: drain new landing files into bronze (stream, exactly once
    per file), then recompute every batch layer from the whole bronze table.

    Bronze is written once, by the stream; lines that did not parse go to the
    ``quarantine_lines`` table.
    """
    from dealscreen.sources.files import good_rows, quarantine
    from dealscreen.streaming.bronze import run_bronze

    run_bronze(spark, landing, checkpoint, target_path=bronze_path, max_files_per_trigger=max_files_per_trigger)
    bronze = spark.read.parquet(bronze_path)
    # Rows that bring an estimate of their own (portal feeds) are a further feed.
    good = good_rows(bronze)
    feeds = [_pinned_feed(f, kw.get("estimate_order", ESTIMATE_ORDER)) for f in estimate_feeds]
    ranked = run_pipeline(spark, good, [*feeds, own_estimates(good)], bronze_written=True, feeds_written=True, **kw)
    _overwrite(quarantine(bronze), PipelineTables.licensed(kw.get("ns") or Namespace.from_spark(spark)).quarantine_lines)
    return ranked
