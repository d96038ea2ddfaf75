"""Landing files: JSON-lines batches in, JSON-lines batches out.

Reads use an explicit schema per feed (field names are case-sensitive in
JSON, and an all-null field would infer as string); malformed lines are kept
in ``_corrupt_record`` instead of failing the read. Writes append one batch
directory per call, named by a UTC label plus a unique batch id, so two
batches in the same second never overwrite each other.
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealscreen.schemas import BRONZE_READ_SCHEMA, CORRUPT_COL, PORTAL_SCHEMA, conform

#: JSON text keeps every microsecond (the writers' default formats cut to milliseconds).
JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}

# Envelope keys of a paged result.
PAGE_VALUE_KEY = "value"
PAGE_NEXT_LINK_KEY = "@odata.nextLink"


def read_bronze(spark: SparkSession, path: str, schema: T.StructType = BRONZE_READ_SCHEMA) -> DataFrame:
    """Batch read of a landing folder (every batch below it) with a frozen schema.

    Lines are read as text and parsed with ``from_json`` (PERMISSIVE): a line
    that does not parse keeps its text in ``_corrupt_record``. Parsing from the
    text column (instead of the JSON file source) keeps every downstream query
    legal, including ones that only count the quarantined lines.
    """
    if CORRUPT_COL not in schema.fieldNames():
        schema = T.StructType(schema.fields + [T.StructField(CORRUPT_COL, T.StringType(), True)])
    lines = spark.read.option("recursiveFileLookup", "true").text(path)
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COL}
    return (
        lines.filter(F.trim(F.col("value")) != "")
        .select(F.from_json(F.col("value"), schema, opts).alias("_r"))
        .select("_r.*")
    )


def read_portal(spark: SparkSession, path: str) -> DataFrame:
    """Portal batches as bronze rows, lines that don't parse included (``_corrupt_record``).

    City and state come under their bronze names; a batch has no modification
    time, so its file's is the version's (later batches are newer).
    """
    fields = [*PORTAL_SCHEMA.fields, T.StructField(CORRUPT_COL, T.StringType(), True)]
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_modification_time").cast("timestamp_ntz").alias("landed"))
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COL}
    rows = lines.filter(F.trim("value") != "").select(
        F.from_json("value", T.StructType(fields), opts).alias("r"), "landed").select("r.*", "landed")
    return conform(rows.withColumn("City", F.col("city")).withColumn("State", F.col("state"))
                   .withColumn("ModificationTimestamp", F.col("landed")), BRONZE_READ_SCHEMA)


def good_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col(CORRUPT_COL).isNull()).drop(CORRUPT_COL) if CORRUPT_COL in df.columns else df


def quarantine(df: DataFrame) -> DataFrame:
    """Lines that did not parse (raw text in ``_corrupt_record``)."""
    return df.filter(F.col(CORRUPT_COL).isNotNull()).select(CORRUPT_COL)


def envelope_schema(record_schema: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField(PAGE_VALUE_KEY, T.ArrayType(record_schema), True),
        T.StructField(PAGE_NEXT_LINK_KEY, T.StringType(), True),
    ])


def flatten_envelopes(pages: DataFrame, record_schema: T.StructType, text_col: str = "body") -> DataFrame:
    """Envelope text rows ``{"value": [...], "@odata.nextLink": ...}`` -> one row per record.

    A page without ``value`` contributes nothing; one that does not parse is
    in ``quarantined_envelopes``. Each page is a row, so the concatenation of
    all pages is just the union of their records.
    """
    env = F.from_json(F.col(text_col), envelope_schema(record_schema))
    return pages.select(F.inline(F.coalesce(env[PAGE_VALUE_KEY], F.array().cast(T.ArrayType(record_schema)))))


def quarantined_envelopes(pages: DataFrame, record_schema: T.StructType, text_col: str = "body") -> DataFrame:
    """The text of the pages that are no JSON of the envelope's shape."""
    schema = T.StructType([*envelope_schema(record_schema).fields, T.StructField(CORRUPT_COL, T.StringType(), True)])
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COL}
    return (pages.select(F.from_json(F.col(text_col), schema, opts)[CORRUPT_COL].alias(CORRUPT_COL))
            .filter(F.col(CORRUPT_COL).isNotNull()))


def read_page_envelopes(spark: SparkSession, path: str, record_schema: T.StructType,
                        multiline: bool = False) -> DataFrame:
    """Saved result pages (one envelope per line, or one per file with ``multiline``)."""
    df = spark.read.schema(envelope_schema(record_schema)).option("multiLine", str(multiline).lower()).json(path)
    return df.select(F.inline(F.coalesce(F.col(f"`{PAGE_VALUE_KEY}`"),
                                         F.array().cast(T.ArrayType(record_schema)))))


def batch_dir(landing: str, prefix: str, label: str) -> str:
    return f"{landing.rstrip('/')}/{prefix}_{label}_{uuid.uuid4().hex[:8]}"


def write_landing(df: DataFrame, landing: str, prefix: str = "listings", label: str | None = None,
                  dry_run: bool = False) -> DataFrame:
    """Append ``df`` as one JSON-lines batch under ``landing``.

    Returns a one-row DataFrame ``n_records`` (bigint). With ``dry_run`` the
    rows are only counted: nothing is written. The count of a real write is
    observed while it is written.
    """
    if dry_run:
        return df.agg(F.count(F.lit(1)).alias("n_records"))
    spark = df.sparkSession
    if label is None:
        label = datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S")
    path = batch_dir(landing, prefix, label)
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n_records")).write.mode("append").option(
        "ignoreNullFields", "false").options(**JSON_TIMES).json(path)
    return spark.createDataFrame([(int(seen.get["n_records"]),)], "n_records bigint")


def write_portal_batch(df: DataFrame, landing: str, dry_run: bool = False) -> DataFrame:
    """Portal search results as one ``public_search_<yyyyMMddTHHmmss>`` batch."""
    label = datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%S")
    return write_landing(df, landing, "public_search", label, dry_run)
