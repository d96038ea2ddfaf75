"""Token ids of all documents in training order: fixed-stride shards for sequential, resumable reads.

Documents, ordered by doc_id and a hash of their text, become byte-level BPE ids, each ended by ``END``, and form one stream
that is cut at every ``SEQ_LEN`` ids (only the corpus's last sequence is filled up with END; it knows its length). A keyed
Feistel network over the next even power of two, walked along its cycle until below N, gives each of the N sequences its slot
in the training order: a permutation, known from key and N alone in both directions. Which ids stand at a slot follows from
key and documents alone, however these are stored or split. Slots are range partitioned into shards of ``SHARD`` records; a
record is ``HEADER`` bytes (doc_id of its first id, that id's place in the document, length) and SEQ_LEN 16-bit ids, so
slot s is at byte s % SHARD * STRIDE of shard s // SHARD: reads are sequential and resume anywhere.

Steps: documents are range partitioned by (doc_id, hash), sorted, encoded and written to the shared folder, each with the
number of ids before it in its range; the driver sees one sum per range (never rows), which gives every range its place in
the stream; the second pass cuts at the stream's fixed places, so that a sequence over two batches is two pieces, permutes,
sends each piece once to its shard's range (a batch's pieces of a shard compressed together), puts the pieces together and
writes the shard under a temporary name, then renames it, so that repeated or speculative tasks leave the same file.
Shards are written once, before the rows that describe them are returned.

Defined cases: null texts are left out, empty ones are only their END; repeated rows are encoded as often as they occur, and
may be dealt over several ranges; null doc_ids are stored as -1; no documents give no shards.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from dealscreen.llm.common import (chunks, discard, freed, mix, pack, read, scratch_dir, shuffle_partitions, unpack)

RANKS, PATTERN = "/opt/tokenizers/byte_bpe_50k.tiktoken", (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")  # fixed: splits text before merges
SEQ_LEN, SHARD, KEY, ROUNDS, END = 512, 4096, "training-order", 6, 50256
PLACE_BYTES = 16 << 20
HEADER = 16
STRIDE = HEADER + 2 * SEQ_LEN


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encode(texts: pa.Array, path: str = RANKS) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts and row offsets into them."""
    enc = encoding(path)
    parts = [enc.encode_to_numpy(t, disallowed_special=()).astype(np.uint16) if t else np.empty(0, np.uint16)
             for t in texts.to_pylist()]
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
    return np.concatenate(parts) if parts else np.empty(0, np.uint16), offsets


def encoded(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """doc_id, at (ids before it in its range) and ids of every document, in ranges of (doc_id, hash of the text)."""
    def run(batches):
        before = 0
        for b in chunks(batches):
            ids, offsets = encode(b.column("text"), path)
            ended = np.full(len(ids) + b.num_rows, END, np.uint16)
            ended[np.arange(len(ids)) + np.repeat(np.arange(b.num_rows), np.diff(offsets))] = ids
            places = offsets + np.arange(len(offsets))
            data = memoryview(ended.tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(before + places[:-1], pa.int64()),
                 pa.array([data[2 * i:2 * j] for i, j in zip(places, places[1:])], pa.binary())],
                names=["doc_id", "at", "ids"])
            before += len(ended)

    # Equal rows may stand in any order, so what tells them apart only deals them over the ranges.
    keys = ["doc_id", "hash", "copy"]
    rows = docs.where("text IS NOT NULL").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("doc_id"), "text", F.xxhash64("text").alias("hash"),
        F.monotonically_increasing_id().alias("copy"))
    return (rows.repartitionByRange(shuffle_partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys)
            .select("doc_id", "text").mapInArrow(run, "doc_id long, at long, ids binary"))


def pieces_of(start: int, stream: np.ndarray, begins: np.ndarray, docs: np.ndarray, seq_len: int) -> tuple:
    """What the sequences get of whole documents that begin at ``begins`` of a stream with ``start`` ids before it: number,
    place in the sequence, ids as rows filled up with END, how many, documents (lists) and the first id's place in its own."""
    edges = np.arange(start // seq_len, -(-(start + len(stream)) // seq_len) + 1) * seq_len - start
    edges[0], edges[-1] = 0, len(stream)
    low, size = edges[:-1], np.diff(edges)
    numbers = start // seq_len + np.arange(len(low))
    inside = np.where(numbers * seq_len < start, start % seq_len, 0)
    ids = np.full((len(low), seq_len), END, np.uint16)
    ids.ravel()[np.arange(len(stream)) + start % seq_len - np.repeat(inside, size)] = stream
    first = np.searchsorted(begins, low, side="right") - 1
    many = np.searchsorted(begins, low + size - 1, side="right") - first
    at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
    return numbers, inside, ids, size, many, docs[at], low - begins[first]


def _squeezed(records: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(records.tobytes())


def _records(data: bytes, stride: int) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(-1, stride)


class Order:
    """The keyed permutation of 0 to n-1: Feistel rounds on halves of bits, cycle-walked until below n."""

    def __init__(self, n: int, key: str = KEY, rounds: int = ROUNDS):
        self.n, self.half = n, max(1, -(-max(1, n - 1).bit_length() // 2))
        self.keys = [np.uint64(int.from_bytes(hashlib.blake2b(f"{key}|{i}".encode(), digest_size=8).digest(), "little"))
                     for i in range(rounds)]
        self.mask = np.uint64((1 << self.half) - 1)

    def _round(self, x, key):
        return mix(x ^ key) & self.mask

    def _once(self, x: np.ndarray, keys) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for key in keys:
            left, right = right, left ^ self._round(right, key)
        return (right << np.uint64(self.half)) | left

    def _walk(self, x: np.ndarray, keys) -> np.ndarray:
        out = self._once(np.asarray(x, np.uint64), keys)
        while (far := out >= np.uint64(self.n)).any():
            out[far] = self._once(out[far], keys)
        return out

    def slots(self, numbers: np.ndarray) -> np.ndarray:
        return self._walk(numbers, self.keys)

    def numbers(self, slots: np.ndarray) -> np.ndarray:
        return self._walk(slots, self.keys[::-1])


def _filesystem(uri: str):
    """File system and path; s3a is Spark's name of what is s3 elsewhere."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def write_shard(uri: str, shard: int, records: np.ndarray) -> str:
    """Records in slot order as one file; written aside and renamed, so that a repeated task is harmless."""
    fs, root = _filesystem(uri)
    fs.create_dir(root, recursive=True)
    name = f"{root}/shard-{shard:08d}.bin"
    aside = f"{root}/.shard-{shard:08d}.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as out:
        out.write(records.tobytes())
    fs.move(aside, name)
    return name


def read_records(uri: str, slot: int, count: int, shard: int = SHARD, seq_len: int = SEQ_LEN) -> list[tuple]:
    """(doc_id, offset, ids) of ``count`` slots from ``slot`` on: resumable sequential reads by place alone."""
    fs, root = _filesystem(uri)
    out, stride = [], HEADER + 2 * seq_len
    while count > 0:
        here = min(count, shard - slot % shard)
        with fs.open_input_file(f"{root}/shard-{slot // shard:08d}.bin") as f:
            data = f.read_at(here * stride, slot % shard * stride)
        for i in range(len(data) // stride):
            doc, offset, n = struct.unpack_from("<qii", data, i * stride)
            out.append((doc, offset, np.frombuffer(data, "<u2", n, i * stride + HEADER)))
        if len(data) < here * stride:
            break
        slot, count = slot + here, count - here
    return out


def training_order(docs: DataFrame, uri: str, seq_len: int = SEQ_LEN, shard: int = SHARD, key: str = KEY,
                   path: str = RANKS) -> DataFrame:
    """One row per sequence: slot, shard, byte_offset, doc_ids, offset, n_ids, ids_sha256; the shards are under uri."""
    spark, stride = docs.sparkSession, HEADER + 2 * seq_len
    held = scratch_dir(spark)
    with freed(spark):
        (encoded(docs, path).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", 6)
         .parquet(held))
    stored = spark.read.parquet(held).withColumn(
        "part", F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int"))
    sums = stored.groupBy("part").agg(F.max(F.col("at") + F.octet_length("ids") / 2).cast("long").alias("n")).collect()
    first, total = {}, 0
    for part, size in sorted((r["part"], r["n"]) for r in sums):
        first[part], total = total, total + size
    if not total:
        return spark.createDataFrame([], _SCHEMA)
    order = Order(-(-total // seq_len), key)
    shards = -(-order.n // shard)

    def place(batches):
        for b in chunks(batches, "ids", PLACE_BYTES):
            base = np.array([first[x] for x in b.column("part").to_pylist()], np.int64)
            starts, docs_ = base + b.column("at").to_numpy(), b.column("doc_id").to_numpy()
            parts = [np.frombuffer(x, np.uint16) for x in b.column("ids").to_pylist()]
            ends = starts + np.array([len(x) for x in parts])
            cuts = np.flatnonzero(starts[1:] != ends[:-1]) + 1
            found = []
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(parts)]):
                found.append(pieces_of(int(starts[i]), np.concatenate(parts[i:j]), starts[i:j] - starts[i], docs_[i:j], seq_len))
            numbers, inside, ids, size, many, listed, offset = (np.concatenate(x) for x in zip(*found))
            slots = order.slots(numbers).astype(np.int64)
            head = np.empty((len(slots), 2), "<i8")
            lists = np.cumsum(many) - many
            head[:, 0] = listed[lists]
            head[:, 1] = offset | (size << 32)
            records = np.concatenate([head.view(np.uint8).reshape(-1, HEADER), ids.view(np.uint8)], axis=1)
            by = np.argsort(slots, kind="stable")
            rows = []
            for own in np.split(by, np.flatnonzero(np.diff(slots[by] // shard)) + 1):
                theirs = np.concatenate([listed[lists[i]:lists[i] + many[i]] for i in own.tolist()])
                rows.append((int(slots[own[0]] // shard), pack(slots[own]), pack(inside[own]), _squeezed(records[own]),
                             pack(many[own]), pack(theirs)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.binary()) for i in range(1, 6)]],
                names=_PLACED)

    def write(number: int, rows: list) -> pa.RecordBatch:
        """The shard's pieces put together in slot order, written as one file and described."""
        slots, inside, many, docs_ = (np.concatenate([unpack(r[c], np.int64) for r in rows])
                                      for c in ("slots", "inside", "many", "docs"))
        records = np.concatenate([_records(r["records"], stride) for r in rows])
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(docs_))
        by = np.lexsort((inside, slots))
        slots, inside, records, lists, many = slots[by], inside[by], records[by], lists.take(pa.array(by)), many[by]
        head = np.ascontiguousarray(records[:, 8:HEADER]).view("<i4")
        size = head[:, 1].astype(np.int64)
        own = np.flatnonzero(np.diff(slots, prepend=-1))
        whole, n_ids = records[own], np.add.reduceat(size, own)
        for i in np.flatnonzero(inside).tolist():  # later pieces of a sequence: at most two for each batch's run
            to, at = np.searchsorted(slots[own], slots[i]), HEADER + 2 * inside[i]
            whole[to, at:at + 2 * size[i]] = records[i, HEADER:HEADER + 2 * size[i]]
        whole[:, 12:HEADER] = n_ids.astype("<i4")[:, None].view(np.uint8)
        write_shard(uri, number, whole)
        ends = np.concatenate([[0], np.cumsum(np.add.reduceat(many, own))])
        return pa.RecordBatch.from_arrays(
            [pa.array(slots[own]), pa.array(np.full(len(own), number, np.int64)), pa.array(slots[own] % shard * stride),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), lists.flatten()),
             pa.array(head[own, 0].astype(np.int64)), pa.array(n_ids),
             pa.array([hashlib.sha256(r[HEADER:HEADER + 2 * k].tobytes()).hexdigest() for r, k in zip(whole, n_ids.tolist())])],
            names=["slot", "shard", "byte_offset", "doc_ids", "offset", "n_ids", "ids_sha256"])

    def write_range(batches):
        at, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if rows and r["shard"] != at:
                    yield write(at, rows)
                    rows = []
                at = r["shard"]
                rows.append(r)
        if rows:
            yield write(at, rows)

    # Contiguous shards a range, told by their number alone: no sampling, which would place everything twice.
    ranges = min(shards, shuffle_partitions(spark))
    placed = stored.mapInArrow(place, "shard long, slots binary, inside binary, records binary, many binary, docs binary")
    out = (placed.repartitionById(ranges, (F.floor(F.col("shard") * ranges / shards)).cast("int"))
           .sortWithinPartitions("shard").mapInArrow(write_range, _SCHEMA))
    described = scratch_dir(spark)
    with freed(spark):
        out.write.option("compression", "zstd").parquet(described)
    discard(spark, held)
    return spark.read.schema(_SCHEMA).parquet(described)


_PLACED = ["shard", "slots", "inside", "records", "many", "docs"]
_SCHEMA = "slot long, shard long, byte_offset long, doc_ids array<long>, offset long, n_ids long, ids_sha256 string"


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order(read(spark, sf_dir, "documents"), scratch_dir(spark) + "/shards")
