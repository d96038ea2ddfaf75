"""Shared helpers: scratch tables in the shared folder, byte-bounded Arrow batches, vectorised word splitting."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

from dealscreen.config import checkpoint_root

CHUNK_BYTES = 6 << 20

_LIBC = ctypes.CDLL(None)

#: One byte per ASCII letter A-Z is mapped to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def scratch_dir(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir; only a local session without one (tests) gets a folder of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None) or checkpoint_root(spark)
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession):
    """What a write shuffles is freed when it has ended, not when the driver happens to collect garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write to the shared folder (to ``path``, or a fresh one) and read back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, path or scratch_dir(df.sparkSession)
    with freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialise_buckets(df: DataFrame, key: str, buckets: int, path: str, compression: str = "snappy") -> DataFrame:
    """The same, in buckets by a key: joins on it leave these rows where they are.

    Buckets are told by a table's entry in the catalog; the entry is dropped once it is read, the files stay.
    """
    spark, name = df.sparkSession, f"llm_{uuid.uuid4().hex}"
    with freed(spark):
        df.write.bucketBy(buckets, key).option("path", path).option("compression", compression).saveAsTable(name, format="parquet")
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that was written to ``path``, once nothing reads it any more."""
    table = spark._jvm.org.apache.hadoop.fs.Path(path)
    table.getFileSystem(spark._jsc.hadoopConfiguration()).delete(table, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` text bytes each; a longer single row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def give_back() -> None:
    """Memory that is free in this process goes back to the system."""
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


def returned(run: Callable) -> Callable:
    """The same function of batches; its worker, which waits for further tasks, keeps no free memory when a task ends."""
    def with_return(batches):
        yield from run(batches)
        give_back()

    return with_return


def remap(texts: pa.Array, table: np.ndarray) -> pa.Array:
    """Apply a byte table that leaves bytes above 127 alone to all texts (nulls become empty)."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.string())])
    if not len(texts):
        return texts
    _, offsets, data = texts.buffers()
    mapped = table[np.frombuffer(data, np.uint8)] if data is not None and data.size else np.empty(0, np.uint8)
    return pa.StringArray.from_buffers(len(texts), offsets, pa.py_buffer(mapped.tobytes()), None, 0, texts.offset)


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts in order, and row offsets into them (nulls have no words)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.string()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.values
    full = pc.greater(pc.binary_length(words), 0)
    kept = np.zeros(len(words) + 1, np.int64)
    np.cumsum(full.to_numpy(zero_copy_only=False), out=kept[1:])
    return words.filter(full), kept[offsets]


def coded(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Integer codes of the words and the distinct words they index."""
    d = words.dictionary_encode()
    return d.indices.to_numpy().astype(np.int64), d.dictionary


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row number of every element."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


_PACK, _UNPACK = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(values: np.ndarray) -> bytes:
    """Integers as byte planes, compressed; ``unpack`` needs the dtype again."""
    v = np.ascontiguousarray(values)
    return _PACK.compress(v.view(np.uint8).reshape(-1, v.dtype.itemsize).T.tobytes()) if len(v) else b""


def unpack(data: bytes, dtype) -> np.ndarray:
    if not data:
        return np.empty(0, dtype)
    n = np.dtype(dtype).itemsize
    planes = np.frombuffer(_UNPACK.decompress(data), np.uint8).reshape(n, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix constants)."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def window_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive elements of h, by combining windows of doubled length."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    mul = np.uint64(0x9E3779B97F4A7C15)
    power, length, out, size = h.astype(np.uint64), 1, None, 0
    while True:
        if n & length:
            if out is None:
                out, size = power, length
            else:
                m = len(h) - size - length + 1
                out = mix(out[:m] * mul + power[size:size + m])
                size += length
        length *= 2
        if length > n:
            return out
        m = len(h) - length + 1
        power = mix(power[:m] * mul + power[length // 2:length // 2 + m])


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive elements."""
    if len(h) < w:
        return np.empty(0, h.dtype)
    size, cur = 1, h
    while size * 2 <= w:
        cur = np.minimum(cur[:len(cur) - size], cur[size:])
        size *= 2
    if size < w:
        cur = np.minimum(cur[:len(h) - w + 1], cur[w - size:])
    return cur


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
