"""Bronze as a Structured Streaming table over the landing folder.

Every trigger picks up only files it has not seen (tracked in the
checkpoint), so re-running is exactly-once per file; ``availableNow`` drains
what is there and stops, which is how the scheduled batch runs it. Files and
folders whose names start with ``_`` or ``.`` (state, markers) are ignored by
the file source. Malformed lines land in ``_corrupt_record``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealscreen.schemas import BRONZE_READ_SCHEMA, CORRUPT_COL


def read_bronze_stream(spark: SparkSession, landing: str, schema: T.StructType = BRONZE_READ_SCHEMA,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming read of new landing files; lines parsed like ``read_bronze``."""
    if CORRUPT_COL not in schema.fieldNames():
        schema = T.StructType(schema.fields + [T.StructField(CORRUPT_COL, T.StringType(), True)])
    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(int(max_files_per_trigger)))
    # Every file below the landing root, at any depth, as the batch read sees it.
    lines = reader.option("recursiveFileLookup", "true").text(landing)
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COL}
    return (
        lines.filter(F.trim(F.col("value")) != "")
        .select(F.from_json(F.col("value"), schema, opts).alias("_r"))
        .select("_r.*")
    )


def committed_batches(spark: SparkSession, checkpoint: str) -> int:
    """The next micro-batch's number by the checkpoint's commit log."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{checkpoint.rstrip('/')}/commits")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    return max((int(n) + 1 for n in names if n.isdigit()), default=0)


def run_bronze(spark: SparkSession, landing: str, checkpoint: str, target_path: str | None = None,
               table: str | None = None, schema: T.StructType = BRONZE_READ_SCHEMA,
               max_files_per_trigger: int | None = None) -> int:
    """Drain the landing folder into the bronze sink (parquet path or table).

    Returns the number of micro-batches that this call committed.
    """
    before = committed_batches(spark, checkpoint)
    stream = read_bronze_stream(spark, landing, schema, max_files_per_trigger)
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(availableNow=True)
    q = writer.toTable(table) if table else writer.start(target_path)
    q.awaitTermination()
    return committed_batches(spark, checkpoint) - before
