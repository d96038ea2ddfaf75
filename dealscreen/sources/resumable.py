"""Resumable pulls: ordered batches of bounded size, each committed by a mark (time, key); every row lands exactly once.

New rows are those behind the last mark in the order (modification time, key). A row that arrives later but shares the
mark's instant may have a smaller key, so the instant itself is looked at again: keys that were pulled at it are kept
beside the marks (``edge``) and left out by an anti-join. Rows whose time lies before the last mark's are not seen
again, as for any high-water mark; rows without a time are never pulled.

A pull is cut into batches along the order: positions come from a range partitioning of (time, key) alone, and the
last position of each batch is its bound (one row a batch reaches the driver). A batch is written under a hidden name
(``_`` in front: neither batch nor stream readers see it), then its edge, then its mark; the mark commits it and the folder
gets its visible name. Stopped before the mark, the next pull overwrites the hidden folder; stopped after it, the next pull first
gives it its name. A pull without new rows writes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from dealscreen.config import pin
from dealscreen.operators.rank import global_row_number
from dealscreen.sources.files import JSON_TIMES
from dealscreen.sources.incremental import TS_COL, pull_filter

_MARKS = "n long, time timestamp_ntz, key string, folder string, n_records long"


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


@dataclass(frozen=True)
class PullState:
    """Marks and edges of one feed under ``path``."""

    spark: SparkSession
    path: str

    def last(self) -> Row | None:
        """The mark that counts: the one of the latest batch."""
        fs, p = _path(self.spark, f"{self.path}/marks")
        if not fs.exists(p):
            return None
        marks = self.spark.read.schema(_MARKS).option("recursiveFileLookup", "true").parquet(f"{self.path}/marks")
        return marks.orderBy(F.col("n").desc()).limit(1).first()

    def commit(self, n: int, time, key: str, folder: str, n_records: int) -> None:
        row = self.spark.createDataFrame([(n, time, key, folder, n_records)], _MARKS).coalesce(1)
        row.write.mode("overwrite").parquet(f"{self.path}/marks/{n:09d}")

    def keep_edge(self, n: int, keys: DataFrame) -> None:
        keys.write.mode("overwrite").parquet(f"{self.path}/edge/{n:09d}")

    def edge(self, time) -> DataFrame:
        """Keys that were pulled at an instant."""
        rows = self.spark.read.schema("time timestamp_ntz, key string").option("recursiveFileLookup", "true").parquet(f"{self.path}/edge")
        return rows.where(F.col("time") == F.lit(time)).select("key")


def _show(spark: SparkSession, folder: str) -> None:
    """Give a committed batch its visible name (again, if an earlier pull stopped just before)."""
    parent, _, name = folder.rpartition("/")
    fs, hidden = _path(spark, f"{parent}/_{name}")
    if fs.exists(hidden):
        fs.rename(hidden, _path(spark, folder)[1])


def unpulled(source: DataFrame, state: PullState, key_col: str, ts_col: str = TS_COL, select: Sequence[str] | None = None) -> DataFrame:
    """The source's rows behind the last mark, with their place in the order (``_time``, ``_key``)."""
    mark = state.last()
    wanted = None if select is None else [*select, key_col]
    rows = pull_filter(source, None if mark is None else mark.time, wanted, inclusive=True, ts_col=ts_col)
    rows = rows.where(F.col(ts_col).isNotNull()).withColumns({
        "_time": F.col(ts_col).cast("timestamp_ntz"), "_key": F.coalesce(F.col(key_col).cast("string"), F.lit(""))})
    if mark is None:
        return rows
    pulled = state.edge(mark.time).select(F.lit(mark.time).cast("timestamp_ntz").alias("_time"), F.col("key").alias("_key")).distinct()
    return rows.join(pulled, ["_time", "_key"], "left_anti")


def resumable_pull(source: DataFrame, landing: str, state_path: str, key_col: str = "ListingKey", batch_rows: int = 1_000_000,
                   select: Sequence[str] | None = None, ts_col: str = TS_COL, prefix: str = "listings",
                   max_batches: int | None = None) -> list[Row]:
    """Pull new rows in batches of about ``batch_rows`` (rows with equal time and key stay together); the batches' marks."""
    spark = source.sparkSession
    state = PullState(spark, state_path.rstrip("/"))
    mark = state.last()
    if mark is not None:
        _show(spark, mark.folder)
    new = unpulled(source, state, key_col, ts_col, select)
    order = [F.col("_time"), F.col("_key")]
    places = global_row_number(new.select("_time", "_key"), order, "place")
    bounds = (places.groupBy(F.expr(f"(place - 1) div {int(batch_rows)}").alias("b")).agg(F.max(F.struct("_time", "_key")).alias("to"))
              .select("to.*").distinct().orderBy("_time", "_key"))
    # One row a batch; the new rows themselves are written once, so that all batches are cut from the same source.
    cuts = bounds.collect() if max_batches is None else bounds.limit(max_batches).collect()
    if not cuts:
        return []
    rows, out = pin(new, "pull"), []
    n, low = (0 if mark is None else mark.n + 1), None
    for cut in cuts:
        here = F.struct("_time", "_key")
        bound = lambda r: F.struct(F.lit(r["_time"]).cast("timestamp_ntz").alias("_time"), F.lit(r["_key"]).alias("_key"))
        batch = rows.where((here <= bound(cut)) & (F.lit(True) if low is None else here > bound(low)))
        folder = f"{landing.rstrip('/')}/{prefix}_pull_{n:09d}"
        hidden = f"{landing.rstrip('/')}/_{prefix}_pull_{n:09d}"
        batch.drop("_time", "_key").write.mode("overwrite").option("ignoreNullFields", "false").options(**JSON_TIMES).json(hidden)
        state.keep_edge(n, batch.where(F.col("_time") == F.lit(cut["_time"])).select(F.col("_time").alias("time"), F.col("_key").alias("key")))
        state.commit(n, cut["_time"], cut["_key"], folder, batch.count())
        _show(spark, folder)
        out.append(state.last())
        n, low = n + 1, cut
    return out
