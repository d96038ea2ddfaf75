"""Point lookups by parcel that are no scans: a second layout of the served rows, in key order, with Parquet bloom filters.

The rows are range-partitioned and sorted by parcel, so the files' and row groups' smallest and largest keys leave at
most a few row groups for one parcel; a bloom filter on the key leaves none for most parcels that don't exist. Rows
without a parcel can't be looked up and are left out. A parcel with very many rows may span ranges: ``listing_key``
ends the order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row groups of the lookup layout (bytes): small, as one parcel's rows are a few.
ROW_GROUP_BYTES = 8 << 20


def write_lookup(ranked: DataFrame, path: str, key: str = "apn", row_group_bytes: int = ROW_GROUP_BYTES,
                 distinct_keys: int | None = None) -> DataFrame:
    """Write the layout at ``path``; ``distinct_keys`` (per file, estimated if not given) sizes the bloom filters."""
    rows = ranked.where(F.col(key).isNotNull())
    if distinct_keys is None:
        distinct_keys = int(rows.agg(F.approx_count_distinct(key)).first()[0] or 1)
    (rows.repartitionByRange(F.col(key), F.col("listing_key")).sortWithinPartitions(key, "rank_score")
     .write.mode("overwrite").option("parquet.block.size", str(int(row_group_bytes)))
     .option(f"parquet.bloom.filter.enabled#{key}", "true")
     .option(f"parquet.bloom.filter.expected.ndv#{key}", str(max(1, distinct_keys))).parquet(path))
    return ranked.sparkSession.read.schema(ranked.schema).parquet(path)


def lookup(spark: SparkSession, path: str, apns: Sequence[str], key: str = "apn", per_key: int = 1) -> DataFrame:
    """The ``per_key`` best-ranked rows of each of the parcels; the key list is pushed to the scan's row groups."""
    from pyspark.sql import Window

    wanted = sorted({str(a) for a in apns if a is not None})
    rows = spark.read.parquet(path)
    rows = rows.where(F.col(key) == F.lit(wanted[0]) if len(wanted) == 1 else F.col(key).isin(wanted) if wanted else F.lit(False))
    best = Window.partitionBy(key).orderBy(F.col("rank_score").asc_nulls_last(), F.col("listing_key"))
    return rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= per_key).drop("_n")
