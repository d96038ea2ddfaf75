"""Served tables that stay readable while they are replaced: snapshot folders and one switch of the table's location.

``publish`` writes the rows to a new folder beside the older ones and then, with one catalog operation, points the
table at it. A write that fails leaves the table as it was (and a folder that nothing points to). A reader that was
opened before the switch keeps the files of its snapshot, so the old folder stays until ``expire`` is called: that keeps
the current snapshot, a number of earlier ones, and whatever is younger than the longest reader.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_PREFIX = "snapshot-"


def snapshot_root(spark: SparkSession, table: str) -> str:
    """The folder of a table's snapshots, under its database's location."""
    db, _, name = table.rpartition(".")
    return f"{spark.catalog.getDatabase(db or spark.catalog.currentDatabase()).locationUri.rstrip('/')}/_snapshots/{name}"


def current_snapshot(spark: SparkSession, table: str) -> str | None:
    """The folder that the table points at, None without a table."""
    if not spark.catalog.tableExists(table):
        return None
    rows = spark.sql(f"DESCRIBE TABLE EXTENDED {table}").where("col_name = 'Location'").select("data_type").collect()
    return rows[-1][0] if rows else None


def publish(df: DataFrame, table: str, root: str | None = None) -> DataFrame:
    """Replace ``table`` by the rows of ``df``; returns the table.

    Columns that change in name or type need a new table definition: only then is the old one dropped first (after the
    new rows are written). A table that was not published before is taken over in the same way.
    """
    spark = df.sparkSession
    root = root or snapshot_root(spark, table)
    path = f"{root.rstrip('/')}/{_PREFIX}{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    df.write.parquet(path)
    columns = [(f.name, f.dataType) for f in spark.read.parquet(path).schema.fields]
    location = current_snapshot(spark, table)
    if location is not None and _PREFIX in location and [(f.name, f.dataType) for f in spark.read.table(table).schema.fields] == columns:
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{path}'")
        spark.catalog.refreshTable(table)
    else:
        if location is not None:
            spark.sql(f"DROP TABLE {table}")
        spark.catalog.createTable(table, path=path, source="parquet")
    return spark.read.table(table)


def expire(spark: SparkSession, table: str, keep: int = 2, min_age_seconds: float = 86400.0, root: str | None = None) -> list[str]:
    """Delete snapshots beyond the newest ``keep`` that are older than the longest reader; never the current one."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root or snapshot_root(spark, table))
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    current = (current_snapshot(spark, table) or "").rstrip("/").rpartition("/")[2]
    found = sorted((s for s in fs.listStatus(base) if s.getPath().getName().startswith(_PREFIX)), key=lambda s: s.getPath().getName())
    limit, gone = (time.time() - min_age_seconds) * 1e9, []
    for s in found[:max(0, len(found) - keep)]:
        name = s.getPath().getName()
        if name != current and int(name.removeprefix(_PREFIX).split("-")[0]) < limit:
            fs.delete(s.getPath(), True)
            gone.append(name)
    return gone
