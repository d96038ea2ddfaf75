"""Bronze stream with two sinks: each micro-batch's good and bad lines, split in one pass, once each however often it is replayed.

``foreachBatch`` may run a batch again after a failure, with the same batch id. A batch is written once, partitioned by
where its lines go, into a hidden staging folder; then each part becomes the folder ``batch=<id>`` of its table by a
rename, replacing what an earlier attempt left. So after any number of replays every line is in exactly one of the two tables, once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealscreen.schemas import BRONZE_READ_SCHEMA, CORRUPT_COL
from dealscreen.streaming.bronze import committed_batches, read_bronze_stream

#: Tables under the root, by the part of a batch that they hold.
SINKS = {"good": "bronze", "bad": "quarantine"}


def _move(spark: SparkSession, source: str, target: str) -> None:
    """The target folder becomes the source folder, or nothing if there is none."""
    to = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs, of = to.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path(source)
    if fs.exists(to):
        fs.delete(to, True)
    if fs.exists(of):
        fs.mkdirs(to.getParent())
        fs.rename(of, to)


def split_batch(root: str, move: Callable = _move) -> Callable[[DataFrame, int], None]:
    """The function that writes a micro-batch to both tables."""
    def write(batch: DataFrame, batch_id: int) -> None:
        spark, staging = batch.sparkSession, f"{root}/_staging/{batch_id:012d}"
        part = F.when(F.col(CORRUPT_COL).isNull(), F.lit("good")).otherwise(F.lit("bad"))
        batch.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(staging)
        for name, table in SINKS.items():
            move(spark, f"{staging}/part={name}", f"{root}/{table}/batch={batch_id}")

    return write


def run_routed(spark: SparkSession, landing: str, checkpoint: str, root: str, schema: T.StructType = BRONZE_READ_SCHEMA,
               max_files_per_trigger: int | None = None, move: Callable = _move) -> int:
    """Drain the landing folder into both tables; the number of micro-batches this call committed."""
    before = committed_batches(spark, checkpoint)
    stream = read_bronze_stream(spark, landing, schema, max_files_per_trigger)
    query = (stream.writeStream.foreachBatch(split_batch(root.rstrip("/"), move)).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return committed_batches(spark, checkpoint) - before


def routed_table(spark: SparkSession, root: str, name: str, schema: T.StructType = BRONZE_READ_SCHEMA) -> DataFrame:
    """``bronze`` (without the corrupt column) or ``quarantine`` (only it), with the batch each line came in."""
    fields = [*schema.fields, *([] if CORRUPT_COL in schema.fieldNames() else [T.StructField(CORRUPT_COL, T.StringType())])]
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
    whole = T.StructType([*fields, T.StructField("batch", T.LongType())])
    if not fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
        rows = spark.createDataFrame([], whole)
    else:
        rows = spark.read.schema(whole).parquet(f"{root.rstrip('/')}/{name}")
    return rows.drop(CORRUPT_COL) if name == "bronze" else rows.select(CORRUPT_COL, "batch")
