"""Incremental pulls: only records modified after the stored high-water mark.

The state is a table of marks in a shared folder, of which the largest counts. A pull
filters the source on ``ModificationTimestamp`` (pushed into the scan for
parquet sources), appends the new records to the landing folder as a JSON-lines batch, and only
then advances the watermark to the largest modification time actually
written. A crash between the two steps re-pulls the same records next time;
the silver deduplication absorbs them (at-least-once delivery).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from dealscreen.sources.files import JSON_TIMES, batch_dir

TS_COL = "ModificationTimestamp"


@dataclass(frozen=True)
class PullResult:
    n_records: int
    watermark: object  # datetime or None
    batch_path: str | None


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def read_watermark(spark: SparkSession, state_path: str):
    """The stored high-water mark, or None when unset (missing or blank)."""
    if not _exists(spark, state_path):
        return None
    wm = F.nullif(F.trim(F.col("watermark").cast("string")), F.lit("")).try_cast("timestamp_ntz")
    return spark.read.parquet(state_path).agg(F.max(wm).alias("w")).first()["w"]


def write_watermark(spark: SparkSession, state_path: str, watermark) -> None:
    """Append a mark; the largest one counts, so a crash never leaves the state without its mark."""
    spark.createDataFrame([(watermark,)], "watermark timestamp_ntz").coalesce(1) \
        .write.mode("append").parquet(state_path)


def _ts_literal(value, dtype: str):
    """A wall-clock literal of the column's own type, independent of the
    session and Python time zones (a naive datetime is a wall-clock time)."""
    import datetime as dt

    if isinstance(value, dt.datetime):
        text = value.replace(tzinfo=None).isoformat(sep=" ") if value.tzinfo is None else \
            value.astimezone(dt.timezone.utc).replace(tzinfo=None).isoformat(sep=" ")
    else:
        text = str(value)
    return F.lit(text).cast(dtype if dtype in ("timestamp", "timestamp_ntz", "date") else "timestamp_ntz")


def pull_filter(source: DataFrame, since=None, select: Sequence[str] | None = None, inclusive: bool = False,
                ts_col: str = TS_COL) -> DataFrame:
    """Source-side projection and predicate: ``select`` columns, rows newer than ``since``."""
    df = source
    has_ts = ts_col in source.columns
    if select:
        cols = list(dict.fromkeys(list(select) + ([ts_col] if has_ts else [])))
        df = df.select(*cols)
    if since is not None and has_ts:
        ts = F.col(ts_col)
        bound = _ts_literal(since, dict(source.dtypes)[ts_col])
        df = df.filter(ts >= bound if inclusive else ts > bound)
    return df


def incremental_pull(source: DataFrame, landing: str, state_path: str, select: Sequence[str] | None = None,
                     inclusive: bool = False, dry_run: bool = False, ts_col: str = TS_COL,
                     prefix: str = "listings") -> PullResult:
    """Pull new records into ``landing`` and advance the watermark.

    Zero records (or a dry run) leave the watermark where it was. A source
    without a modification time cannot be filtered here; its watermark is
    then the (UTC) time the pull started.
    """
    import datetime as dt

    spark = source.sparkSession
    started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    since = read_watermark(spark, state_path)
    new = pull_filter(source, since, select, inclusive, ts_col)
    if dry_run:
        n = new.count()
        return PullResult(n, since, None)
    path = batch_dir(landing, prefix, "pull")
    has_ts = ts_col in new.columns
    # Number and largest time are those of the rows as they are written, not of their text.
    seen = Observation()
    largest = F.max(F.col(ts_col).cast("timestamp_ntz")) if has_ts else F.max(F.lit(None).cast("timestamp_ntz"))
    new.observe(seen, F.count(F.lit(1)).alias("n"), largest.cast("string").alias("w")).write.mode("append").option(
        "ignoreNullFields", "false").options(**JSON_TIMES).json(path)
    n, largest = int(seen.get["n"]), seen.get["w"]
    if n == 0:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        return PullResult(0, since, None)
    wm = (dt.datetime.fromisoformat(largest) if largest else since) if has_ts else started
    if wm is not None:
        write_watermark(spark, state_path, wm)
    return PullResult(n, wm, path)
