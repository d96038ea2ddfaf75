"""Repeated word sequences across documents, by windows of doubling length.

A window that is repeated at one length alone is extended, so a candidate's two halves are both repeated: from the largest
power of two below ``WINDOW`` (13 words: 8) to ``WINDOW`` itself, from two windows that overlap, then 26, 52 and so on until
no candidate survives. Removed are the words covered by a window of ``WINDOW`` words that also starts in a document with a
smaller doc_id, windows being judged on the input; that length's candidates tell it, and the longer ones give each document
the longest length at which one of its windows is repeated.

Documents are packed into chunks of about ``CHUNK`` bytes (a longer one stands alone). For every length a chunk sends each
distinct hash once: sorted, delta-coded, cut by bucket into ranges. A bucket says which of them are repeated, and the chunk
finds its places again. Below ``WINDOW`` every place is one, so they are read from the texts again instead of being stored,
no ids are sent, and of a hash its first ``SHORT`` bits: one of two chunks, or of two documents of one chunk, goes on (more
than the repeated ones, never fewer). From ``WINDOW`` on a chunk keeps the places of its candidates, hashes have 64 bits, and
the smallest and largest doc_id of each are sent and decide. A window that a third of all documents share is one entry a
chunk, however often it occurs. A length's tables are deleted when the next one's are written.

Defined cases: null and empty texts have no words; a null doc_id is larger than every other and not smaller than itself;
rows with equal ids are the same document (they don't remove from each other) and each get a row; a window lies in one
row. Ids are whole numbers (a doc_id that isn't fails the cast).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from dealscreen.llm.common import (coded, discard, materialise, materialise_buckets, mix, pack, read, rows_of,
                                   scratch_dir, shuffle_partitions, split_words, unpack, window_hash)
from dealscreen.llm.xxh import xxh64_slices

WINDOW, CHUNK, SHORT = 13, 4 << 20, 40
_LAST = np.iinfo(np.int64).max
_MUL = np.uint64(0x9E3779B97F4A7C15)
_STATE = ("chunk long, ids binary, at binary, row binary, code binary, longest binary, gone binary, "
          "sent array<struct<bucket:int,h:binary,low:binary,high:binary>>")
_ARROW = pa.schema([("chunk", pa.int64()), *[(x, pa.binary()) for x in ("ids", "at", "row", "code", "longest", "gone")],
                    ("sent", pa.list_(pa.struct([("bucket", pa.int32()), *[(x, pa.binary()) for x in ("h", "low", "high")]])))])
_SENT = "chunk long, bucket int, h binary, low binary, high binary"
_VERDICT = "chunk long, bucket int, kept binary, least binary"


def packed_chunks(docs: DataFrame, limit: int = CHUNK, buckets: int | None = None) -> DataFrame:
    """chunk, ids and texts of about ``limit`` bytes of documents each, written to the shared folder; in buckets by chunk if asked for."""
    def gather(batches):
        ids, texts, size = [], [], 0
        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids.append(i)
                texts.append(t)
                size += len(t or "")
                if size >= limit:
                    yield _one(ids, texts)
                    ids, texts, size = [], [], 0
        if ids:
            yield _one(ids, texts)

    def _one(ids, texts):
        return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.string()))],
                                          names=["ids", "texts"])

    path = scratch_dir(docs.sparkSession)
    packed = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
              .mapInArrow(gather, "ids array<long>, texts array<string>").withColumn("chunk", F.monotonically_increasing_id()))
    if buckets:
        return materialise_buckets(packed, "chunk", buckets, path, compression="zstd")
    packed.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.parquet(path)


def _hashes(words: pa.Array) -> np.ndarray:
    if not len(words):
        return np.empty(0, np.uint64)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    return xxh64_slices(np.frombuffer(words.buffers()[2], np.uint8), ends[:-1], ends[1:])


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes, each place's number among them, the places in their order and where each hash's begin there."""
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(h) else np.empty(0, np.int64)
    code = np.empty(len(h), np.uint32)
    code[order] = np.repeat(np.arange(len(heads), dtype=np.uint32), np.diff(np.append(heads, len(h))))
    return ordered[heads], code, order, heads


def _cuts(distinct: np.ndarray, exact: bool, buckets: int) -> np.ndarray:
    """Where the buckets' ranges of sorted hashes begin."""
    bucket = ((distinct >> np.uint64(32 if exact else SHORT - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    return np.searchsorted(bucket, np.arange(buckets + 1))


def _ranges(distinct: np.ndarray, own: np.ndarray, heads: np.ndarray, exact: bool, buckets: int) -> list:
    """What a chunk sends: by bucket its range of hashes, with the ids (``own``: in the hashes' order) that have each."""
    if not len(heads):
        return []
    sent, cuts = [], _cuts(distinct, exact, buckets)
    low, high = np.minimum.reduceat(own, heads), np.maximum.reduceat(own, heads)
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        a, z = cuts[b], cuts[b + 1]
        sent.append({"bucket": b, "h": pack(np.diff(distinct[a:z], prepend=np.uint64(0))),
                     "low": pack(low[a:z]) if exact else b"",
                     "high": pack(high[a:z] - low[a:z] if exact else np.packbits(low[a:z] != high[a:z]))})
    return sent


def _state(chunk: int, ids: np.ndarray, at: np.ndarray, row: np.ndarray, h: np.ndarray, longest: np.ndarray,
           gone: np.ndarray, exact: bool, buckets: int) -> dict:
    """A chunk's candidates of one length: places, rows, and each distinct hash once, in ranges of hashes by bucket."""
    distinct, code, order, heads = _distinct(h)
    return {"chunk": chunk, "ids": pack(ids), "at": pack(np.diff(at, prepend=0).astype(np.uint32)),
            "row": pack(np.diff(row, prepend=0).astype(np.uint32)), "code": pack(code), "longest": pack(longest),
            "gone": pack(np.diff(gone, prepend=0).astype(np.uint32)), "sent": _ranges(distinct, ids[row[order]], heads, exact, buckets)}


def _batch(states: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(states, schema=_ARROW)


def _places(b: pa.RecordBatch, r: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a chunk its ids, and of every window of its texts the place, row and hash."""
    ids = pc.fill_null(b.column("ids").slice(r, 1).flatten(), _LAST).to_numpy()
    words, offsets = split_words(b.column("texts").slice(r, 1).flatten())
    code, distinct = coded(words)
    row, h = rows_of(offsets), window_hash(_hashes(distinct)[code], length)
    at = np.flatnonzero(row[:len(h)] == row[length - 1:])
    return ids, at, row[at], h[at]


def _words_level(exact: bool, buckets: int):
    """Length 1: every word of a chunk, hashed once for all its places."""
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids, at, row, h = _places(b, r, 1)
                yield _batch([_state(b.column("chunk")[r].as_py(), ids, at, row, h, np.zeros(len(ids), np.int64),
                                     np.empty(0, np.int64), exact, buckets)])

    return run


def _send_short(length: int, buckets: int):
    """The first bits of the hashes of all windows of a length below ``WINDOW``."""
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids, _, row, h = _places(b, r, length)
                distinct, _, order, heads = _distinct(h >> np.uint64(64 - SHORT))
                chunk = b.column("chunk")[r].as_py()
                yield pa.RecordBatch.from_pylist(
                    [{"chunk": chunk, **s} for s in _ranges(distinct, ids[row[order]], heads, False, buckets)],
                    schema=pa.schema([("chunk", pa.int64()), *_ARROW.field("sent").type.value_type]))

    return run


def _longer(at: np.ndarray, row: np.ndarray, h: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Which windows have one ``step`` places on in their row, and the hash of both."""
    slot = np.minimum(np.searchsorted(at, at + step), max(len(at) - 1, 0))
    both = np.flatnonzero((at[slot] == at + step) & (row[slot] == row))
    return both, mix(h[both] * _MUL + h[slot[both]])


def _from_short(length: int, window: int, buckets: int):
    """A chunk's windows of ``window`` words whose first and last ``length`` words, which cover them, are both repeated."""
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                ids, at, row, h = _places(b, r, length)
                distinct, code, _, _ = _distinct(h >> np.uint64(64 - SHORT))
                cuts, kept = _cuts(distinct, False, buckets), np.zeros(len(distinct), bool)
                for v in b.column("verdicts")[r].as_py() or ():
                    own = slice(cuts[v["bucket"]], cuts[v["bucket"] + 1])
                    kept[own] = np.unpackbits(unpack(v["kept"], np.uint8), count=own.stop - own.start)
                left = kept[code]
                at, row = at[left], row[left]
                both, h = _longer(at, row, h[left], window - length)
                yield _batch([_state(b.column("chunk")[r].as_py(), ids, at[both], row[both], h, np.zeros(len(ids), np.int64),
                                     np.empty(0, np.int64), True, buckets)])

    return run


def _verdicts(exact: bool):
    """Which of a bucket's hashes are repeated; where ids were sent, by the smallest and largest of all chunks.

    Without ids a hash is repeated where two chunks have it or one chunk has it in two documents.
    """
    def run(table: pa.Table) -> pa.Table:
        hashes = [np.cumsum(unpack(x, np.uint64), dtype=np.uint64) for x in table["h"].to_pylist()]
        size = np.array([len(x) for x in hashes])
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        heads = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        count = np.diff(np.append(heads, len(h)))
        group = np.empty(len(h), np.int64)
        group[order] = np.repeat(np.arange(len(heads)), count)
        if exact:
            low = np.concatenate([unpack(x, np.int64) for x in table["low"].to_pylist()])
            high = low + np.concatenate([unpack(x, np.int64) for x in table["high"].to_pylist()])
            least = np.minimum.reduceat(low[order], heads)
            several, least = least != np.maximum.reduceat(high[order], heads), least[group]
        else:
            here = np.concatenate([np.unpackbits(unpack(x, np.uint8), count=n) for x, n in
                                   zip(table["high"].to_pylist(), size.tolist())])
            several, least = (count > 1) | np.logical_or.reduceat(here[order] > 0, heads), np.zeros(len(h), np.int64)
        kept, out, ends = several[group], [], np.cumsum(size)
        for chunk, bucket, a, z in zip(table["chunk"].to_pylist(), table["bucket"].to_pylist(), ends - size, ends):
            k = kept[a:z]
            if k.any():
                out.append((chunk, bucket, pack(np.packbits(k)), pack(least[a:z][k]) if exact else b""))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in
                         enumerate([pa.int64(), pa.int32(), pa.binary(), pa.binary()])],
                        names=["chunk", "bucket", "kept", "least"])

    return run


def _extend(length: int, window: int, buckets: int):
    """A chunk's repeated windows, joined to those of twice the length.

    A longer window is a candidate where the windows at its start and at its end are both repeated. A repeated one counts
    for its row's longest; at ``window`` the places after a smaller id are told.
    """
    def run(batches):
        for b in batches:
            for x in b.to_pylist():
                ids, row = unpack(x["ids"], np.int64), np.cumsum(unpack(x["row"], np.uint32), dtype=np.int64)
                at = np.cumsum(unpack(x["at"], np.uint32), dtype=np.int64)
                longest, gone = unpack(x["longest"], np.int64), np.cumsum(unpack(x["gone"], np.uint32), dtype=np.int64)
                h, kept, least = [np.empty(0, np.uint64)], [np.empty(0, bool)], [np.empty(0, np.int64)]
                told = {v["bucket"]: v for v in x["verdicts"] or ()}
                for s in x["sent"]:
                    h.append(np.cumsum(unpack(s["h"], np.uint64), dtype=np.uint64))
                    v = told.get(s["bucket"])
                    kept.append(np.unpackbits(unpack(v["kept"], np.uint8), count=len(h[-1])).astype(bool) if v
                                else np.zeros(len(h[-1]), bool))
                    least.append(np.zeros(len(h[-1]), np.int64))
                    least[-1][kept[-1]] = unpack(v["least"], np.int64) if v else 0
                code = unpack(x["code"], np.uint32)
                left = np.concatenate(kept)[code]
                at, row, code = at[left], row[left], code[left]
                longest = longest.copy()
                longest[row] = length
                if length == window:
                    gone = at[ids[row] > np.concatenate(least)[code]]
                both, own = _longer(at, row, np.concatenate(h)[code], length)
                yield _batch([_state(x["chunk"], ids, at[both], row[both], own, longest, gone, True, buckets)])

    return run


def _judged(sent: DataFrame, exact: bool, path: str) -> DataFrame:
    """By chunk, which of its hashes are repeated."""
    verdicts = materialise(sent.groupBy("bucket").applyInArrow(_verdicts(exact), _VERDICT), path)
    return verdicts.groupBy("chunk").agg(F.collect_list(F.struct("bucket", "kept", "least")).alias("verdicts")).hint("merge")


def levels(chunks: DataFrame, window: int = WINDOW) -> DataFrame:
    """chunk, longest, gone: the doubling from the first length on until no candidate survives.

    Each length's candidates are one table; it and the verdicts on it are deleted when the next length's is written. The
    tables are bucketed by chunk, so that only hashes and verdicts are shuffled (and the chunks, unless they are, too).
    """
    spark, path, judged = chunks.sparkSession, scratch_dir(chunks.sparkSession), scratch_dir(chunks.sparkSession)
    parts = shuffle_partitions(spark)
    given = chunks.select("chunk", "ids", "texts")
    if window > 1:
        short = 1 << (window - 1).bit_length() - 1
        verdicts = _judged(given.mapInArrow(_send_short(short, 2 * parts), _SENT), False, judged)
        state = materialise_buckets(given.join(verdicts, "chunk", "left").mapInArrow(
            _from_short(short, window, 2 * parts), _STATE), "chunk", parts, path)
        discard(spark, judged)
    else:
        state = materialise_buckets(given.mapInArrow(_words_level(True, 2 * parts), _STATE).repartition(parts, "chunk"),
                                    "chunk", parts, path)
    length = window
    while not state.where(F.size("sent") > 0).isEmpty():
        judged = scratch_dir(spark)
        verdicts = _judged(state.select("chunk", F.explode("sent").alias("s")).select("chunk", "s.*"), True, judged)
        before, path = path, scratch_dir(spark)
        state = materialise_buckets(state.join(verdicts, "chunk", "left").mapInArrow(
            _extend(length, window, 2 * parts), _STATE), "chunk", parts, path)
        discard(spark, before)
        discard(spark, judged)
        length *= 2
    return state.select("chunk", "longest", "gone")


def _assemble(window: int):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                texts = b.column("texts").slice(r, 1).flatten()
                ids = b.column("ids").slice(r, 1).flatten()
                words, offsets = split_words(texts)
                cover = np.zeros(len(words) + 1, np.int64)
                at = np.cumsum(unpack(b.column("gone")[r].as_py(), np.uint32), dtype=np.int64)
                np.add.at(cover, at, 1)
                np.add.at(cover, at + window, -1)
                longest = unpack(b.column("longest")[r].as_py(), np.int64)
                removed = np.cumsum(cover[:-1]) > 0
                gone = np.concatenate([[0], np.cumsum(removed)])
                hashes = []
                for i, t in enumerate(texts.to_pylist()):
                    a, z = offsets[i], offsets[i + 1]
                    own = (t or "").encode().split()
                    if gone[z] > gone[a]:
                        own = [w for w, x in zip(own, removed[a:z].tolist()) if not x]
                    hashes.append(hashlib.sha256(b" ".join(own)).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.diff(offsets)), pa.array(gone[offsets[1:]] - gone[offsets[:-1]]),
                     pa.array(hashes, pa.string()), pa.array(longest)],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "longest_window"])

    return run


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and longest_window (0: none) of every document row."""
    chunks = packed_chunks(docs, buckets=shuffle_partitions(docs.sparkSession))
    return chunks.join(levels(chunks, window), "chunk").select("ids", "texts", "longest", "gone").mapInArrow(
        _assemble(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, longest_window long")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))


#: The contract's columns, with every window spelled out, and the longest length by the same doubling.
OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
t AS (SELECT unnest(range(0, 12)) AS j),
l AS (SELECT CAST(13 * power(2, j) AS BIGINT) AS n FROM t WHERE 13 * power(2, j) <= (SELECT max(len(w)) FROM d)),
win AS (SELECT r, doc_id, n, s, md5(array_to_string(w[s:s + n - 1], ' ')) AS x FROM (
    SELECT r, doc_id, w, n, unnest(range(1, CAST(len(w) - n + 2 AS BIGINT))) AS s FROM d, l WHERE len(w) >= n)),
low AS (SELECT n, x, min(doc_id) AS low, max(doc_id) AS high FROM win GROUP BY n, x),
rep AS (SELECT win.r, win.n, max(win.doc_id > low.low AND win.n = 13) AS hit FROM win JOIN low USING (n, x)
    WHERE low.low <> low.high GROUP BY win.r, win.n),
best AS (SELECT r, max(n) AS longest FROM rep GROUP BY r),
cov AS (SELECT DISTINCT r, p FROM (SELECT win.r, unnest(range(win.s, win.s + 13)) AS p FROM win JOIN low USING (n, x)
    WHERE win.n = 13 AND win.doc_id > low.low)),
gone AS (SELECT r, list(p) AS ps, count(*) AS c FROM cov GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(c, 0) AS BIGINT) AS n_removed,
    sha256(array_to_string(CASE WHEN c IS NULL THEN w ELSE
        list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256,
    CAST(coalesce(longest, 0) AS BIGINT) AS longest_window
FROM d LEFT JOIN gone USING (r) LEFT JOIN best USING (r)
"""
