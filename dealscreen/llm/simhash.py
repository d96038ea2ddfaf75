"""SimHash near-duplicates by multi-index hashing.

Fingerprint: 64 bits over the XXH64 (seed 42) of all word 3-shingles, repeats included; a bit is 1 if set in over half.
Fingerprints within ``distance`` bits are linked, components take their smallest doc_id.

Search: distinct fingerprints only (copies collapse before any join). A fingerprint is cut into ``segments`` parts; two
within the distance agree in one part up to distance // segments bits, so every part's Hamming ball of that radius is
enumerated, looked up in the table (segment, value) and the complete distance is verified. Table buckets are read up to
``bucket`` entries. Fingerprints that probe a larger bucket (found exactly, not dropped) instead enumerate the ball of
half the distance over all 64 bits: two within the distance meet at a common centre, whose group can't exceed the ball's
size; linking each group's members (complete distance verified) to one another is exact too and grows linearly.

Components: alternating large-star / small-star rounds on the fingerprint links, each round a table in the shared folder.

Defined cases: texts without words (null, empty, blank) have fingerprint zero and are linked like any other; rows without
doc_id take part but never name a component (a component of only such rows has a null id); repeated rows each get a row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from dealscreen.llm.common import LOWER, chunks, materialise, read, remap, returned, rows_of, split_words
from dealscreen.llm.xxh import xxh64_slices

SHINGLE, DISTANCE, SEGMENTS, BUCKET = 3, 2, 2, 64

#: The bits of every byte value, lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


#: Text bytes hashed at once: a batch's words and hashes take some twenty times as much.
CHUNK = 2 << 20


def simhashes(texts: pa.Array, shingle: int = SHINGLE) -> np.ndarray:
    """Signed 64-bit fingerprints of all texts."""
    words, offsets = split_words(remap(texts, LOWER))
    n = np.diff(offsets)
    out = np.zeros(len(n), np.int64)
    if not len(words):
        return out
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words), " ")
    row = rows_of(offsets)
    first = offsets[:-1][row]
    width = np.diff(np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1]).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(width)])[:-1]
    base = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset:joined.offset + len(n)].astype(np.int64)
    starts = base[row] + at - at[first] + np.arange(len(words)) - first
    count = np.maximum(n - shingle + 1, np.minimum(n, 1))
    begin = np.arange(len(words)) - first < count[row]
    last = np.minimum(np.flatnonzero(begin) + shingle, offsets[1:][row[begin]]) - 1
    data = np.frombuffer(joined.buffers()[2], np.uint8)
    h = xxh64_slices(data, starts[begin], starts[last] + width[last])
    lanes = h.view(np.uint8).reshape(-1, 8)
    ends = np.cumsum(count)
    for r in np.flatnonzero(n):
        own = lanes[ends[r] - count[r]:ends[r]]
        ones = np.stack([np.bincount(own[:, i], minlength=256) for i in range(8)]) @ _BITS
        out[r] = np.packbits((2 * ones > count[r]).ravel(), bitorder="little").view(np.int64)[0]
    return out


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, keep: list[str] | None = None) -> DataFrame:
    """row (the document, all columns or those to keep) and its fingerprint as a signed long.

    The text travels to Python once, beside the other columns, and back only if it is kept.
    """
    kept = [c for c in docs.columns if keep is None or c in keep]
    others, whole = [c for c in kept if c != "text"], "text" in kept

    def add(batches):
        for b in chunks(batches, limit=CHUNK):
            fp = pa.array(simhashes(b.column("text"), shingle), pa.int64())
            columns = {"row": b.column("row"), "fingerprint": fp, **({"text": b.column("text")} if whole else {})}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    rows = docs.select(F.struct(*others, F.lit(None).cast("byte").alias("_")).alias("row"), F.col("text").cast("string").alias("text"))
    schema = f"row {rows.schema['row'].dataType.simpleString()}, fingerprint long{', text string' if whole else ''}"
    row = F.struct(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in kept]).alias("row")
    return rows.mapInArrow(returned(add), schema).select(row, "fingerprint")


def _masks(bits: int, radius: int) -> list[int]:
    """All masks of at most ``radius`` set bits, as signed longs."""
    out = [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in out]


def _probe(segment: int, value):
    return lambda mask: F.struct(F.lit(segment).alias("seg"), value.bitwiseXOR(mask).alias("value"))


def _near(a, b, distance: int):
    return F.bit_count(a.bitwiseXOR(b)) <= distance


def near_pairs(fps: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS, bucket: int = BUCKET) -> DataFrame:
    """Linked pairs (a < b), each found at least once, of the distinct fingerprints ``fp``."""
    bounds = [64 * i // segments for i in range(segments + 1)]
    table, probes = [], []
    for i in range(segments):
        width = bounds[i + 1] - bounds[i]
        value = F.shiftrightunsigned("fp", bounds[i]).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
        table.append(F.struct(F.lit(i).alias("seg"), value.alias("value")))
        ball = F.array(*[F.lit(m) for m in _masks(width, distance // segments)])
        probes.append(F.transform(ball, _probe(i, value)))
    entries = fps.select("fp", F.inline(F.array(*table)))
    w = Window.partitionBy("seg", "value").orderBy("fp")
    buckets = (entries.withColumn("n", F.row_number().over(w)).where(F.col("n") <= bucket + 1)
               .groupBy("seg", "value").agg(F.collect_list("fp").alias("fps")))
    # Spark takes a ball for one row, so it would broadcast all of them: neither side ever is.
    met = fps.select("fp", F.inline(F.flatten(F.array(*probes)))).join(buckets.hint("merge"), ["seg", "value"]).select(
        "fp", F.when(F.size("fps") <= bucket, F.filter(
            "fps", lambda x: (x > F.col("fp")) & _near(x, F.col("fp"), distance))).alias("found"))
    met = materialise(met.where("found IS NULL OR size(found) > 0"))
    pairs = met.where("found IS NOT NULL").select(F.col("fp").alias("a"), F.explode("found").alias("b"))
    hot = met.where("found IS NULL").select("fp").distinct()
    ball = F.array(*[F.lit(m) for m in _masks(64, (distance + 1) // 2)])
    groups = (hot.select("fp", F.explode(F.transform(ball, lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
              .groupBy("centre").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where("size(fps) > 1"))
    # An even distance: all members of a group are within it of each other, a chain of them is enough.
    if distance % 2 == 0:
        linked = groups.select(F.inline(F.transform(
            F.sequence(F.lit(2), F.size("fps")),
            lambda i: F.struct(F.element_at("fps", i - 1).alias("a"), F.element_at("fps", i).alias("b")))))
    else:
        linked = (groups.select("fps", F.explode("fps").alias("a")).select("a", F.explode("fps").alias("b"))
                  .where((F.col("a") < F.col("b")) & _near(F.col("a"), F.col("b"), distance)))
    return pairs.union(linked).distinct()


def components(links: DataFrame) -> DataFrame:
    """node and its component's smallest node, for every node with a link (a, b)."""
    edges = materialise(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .where("a <> b").distinct())
    state = None
    while True:
        # Large star: every larger neighbour points at the smallest one around.
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = (both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct())
        # Small star: smaller neighbours and the node itself point at the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (large.join(low, "a").select(F.explode(F.array(
            F.struct(F.col("b").alias("a"), F.col("low").alias("b")),
            F.struct(F.col("a"), F.col("low").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct())
        edges = materialise(small)
        new = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if new == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = new


def _with_root(marked: DataFrame, distance: int, segments: int, bucket: int) -> DataFrame:
    """Rows (id, fingerprint and others) with their component's smallest fingerprint and id."""
    light = materialise(marked.groupBy("fingerprint").agg(F.min("id").alias("id")))
    roots = components(near_pairs(light.select(F.col("fingerprint").alias("fp")), distance, segments, bucket))
    named = light.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "id", F.coalesce("root", "fingerprint").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    return marked.join(named.join(least, "root").select("fingerprint", "root", "component_id"), "fingerprint")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, segments: int = SEGMENTS,
                    bucket: int = BUCKET, keep: list[str] | None = None) -> DataFrame:
    """row, fingerprint (long), root (the component's smallest fingerprint) and component_id of every document row.

    The rows with fingerprints are written once.
    """
    marked = materialise(with_fingerprint(docs, shingle, keep))
    found = _with_root(marked.withColumn("id", F.col("row.doc_id")), distance, segments, bucket)
    return found.select("fingerprint", "row", "root", "component_id")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    return found.select(F.col("row.doc_id").alias("doc_id"),
                        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each component stays, the one with the smallest id (null last), then the smallest hash of its text.

    Components are told apart by their fingerprints: equal ids in two of them are two documents. The rows are written once,
    numbered; numbers, ids and hashes tell which stay, and only the rows that stay are joined to their numbers.
    """
    marked = materialise(with_fingerprint(docs).select(
        "row", "fingerprint", F.col("row.doc_id").alias("id"), F.xxhash64("row.text").alias("hash"),
        F.monotonically_increasing_id().alias("number")))
    first = Window.partitionBy("root").orderBy(F.col("id").asc_nulls_last(), "hash", "number")
    stays = (_with_root(marked.drop("row"), DISTANCE, SEGMENTS, BUCKET).withColumn("first", F.row_number().over(first))
             .where("first = 1").select("number"))
    return marked.select("number", "row").join(materialise(stays).hint("merge"), "number", "left_semi").select("row.*")
