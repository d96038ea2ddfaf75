"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and split into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``. An item's windows are its
``span`` consecutive words; an item with fewer words, but at least one, is one window. In every ``t``-word stretch of
words the minimum ``k``-gram hash is kept (k = min(5, t)), on both sides, so every shared window of t words has at
least one fingerprint in common. Documents' fingerprints are looked up among the items'; around each hit the up to
t - k + 1 window positions holding it are compared with the items' windows word for word.

The benchmark is the stated query set: it is processed in blocks of at most ``block_bytes`` text (a larger single
item is its own block), each broadcast and run against all documents; block results are merged per row.

Defined cases: null or empty texts have no words; repeated item ids count once; words of an item without id are hit
but the item is not listed; repeated documents each get their own row; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from dealscreen.llm.common import (LOWER, chunks, coded, materialise, mix, read, remap, rows_of, sliding_min,
                                   split_words, window_hash)

SPAN, GRAM, BLOCK_BYTES = 10, 5, 2 << 20

#: Separators become spaces; digits, lower-cased letters and bytes of non-ASCII characters stay.
WORD_BYTES = LOWER.copy()
WORD_BYTES[[c for c in range(128) if not (chr(c).isascii() and chr(c).isalnum())]] = 32

NONE = np.uint64(2**64 - 1)


def gram_fingerprints(ids: np.ndarray, t: int, gram: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash of every k-gram (NONE where a word is unknown), and which of them are a minimum of a t-word stretch."""
    k = min(gram, t)
    h = window_hash(mix(ids.astype(np.uint64)), k)
    if not len(h):
        return h, np.empty(0, bool), k
    bad = np.concatenate([[0], np.cumsum(ids == 0)])
    h = np.where(bad[k:] > bad[:-k], NONE, np.minimum(h, NONE - np.uint64(1)))
    w = t - k + 1
    low = sliding_min(h, w)
    kept = np.zeros(len(h), bool)
    for j in range(w):
        kept[j:j + len(low)] |= h[j:j + len(low)] == low
    return h, kept & (h != NONE), k


class BenchmarkIndex:
    """Fingerprints and windows of one block of benchmark items."""

    def __init__(self, item_ids: list, texts: list, span: int = SPAN, gram: int = GRAM):
        words, offsets = split_words(remap(pa.array(texts, pa.string()), WORD_BYTES))
        codes, self.vocabulary = coded(words)
        self.items, self.span, self.gram = item_ids, span, gram
        windows: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for i in range(len(item_ids)):
            ids = (codes[offsets[i]:offsets[i + 1]] + 1).tolist()
            if ids:
                t = min(span, len(ids))
                for s in range(len(ids) - t + 1):
                    windows[t][tuple(ids[s:s + t])].add(i)
        self.classes = []
        for t, found in sorted(windows.items()):
            ids = np.array(list(found), np.int64).reshape(len(found), t)
            key = np.array([window_hash(mix(r.astype(np.uint64)), t)[0] for r in ids], np.uint64)
            order = np.argsort(key, kind="stable")
            owners = [sorted(x) for x in found.values()]
            kept = [gram_fingerprints(r, t, gram) for r in ids]
            grams = np.unique(np.concatenate([h[m] for h, m, _ in kept]))
            self.classes.append((t, grams, key[order], ids[order], [owners[o] for o in order]))

    def match(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[set]]:
        """Row offsets into the words of all texts, whether each word is hit, and each text's items."""
        words, offsets = split_words(remap(texts, WORD_BYTES))
        n = len(offsets) - 1
        items = [set() for _ in range(n)]
        codes, distinct = coded(words)
        known = pc.fill_null(pc.index_in(distinct, value_set=self.vocabulary), -1).to_numpy().astype(np.int64) + 1
        # A separator (id 0) after each text, so that no window spans two texts.
        row = rows_of(offsets)
        ids = np.zeros(len(codes) + n, np.int64)
        at = np.arange(len(codes)) + row
        ids[at] = known[codes] if len(codes) else 0
        owner = np.zeros(len(ids), np.int64)
        owner[at] = row
        cover = np.zeros(len(ids) + 1, np.int64)
        for t, grams, keys, windows, owners in self.classes:
            h, kept, k = gram_fingerprints(ids, t, self.gram)
            pos = np.flatnonzero(kept)
            if not len(pos):
                continue
            slot = np.minimum(np.searchsorted(grams, h[pos]), len(grams) - 1)
            pos = pos[grams[slot] == h[pos]]
            starts = np.unique((pos[:, None] - np.arange(t - k + 1)).ravel())
            starts = starts[(starts >= 0) & (starts + t <= len(ids))]
            if not len(starts):
                continue
            text_windows = ids[starts[:, None] + np.arange(t)]
            key = window_hash_rows(text_windows)
            first = np.searchsorted(keys, key, side="left")
            last = np.searchsorted(keys, key, side="right")
            for step in range(int((last - first).max(initial=0))):  # more than one only where 64-bit keys collide
                slot = np.minimum(first + step, len(keys) - 1)
                same = (first + step < last) & (windows[slot] == text_windows).all(axis=1)
                np.add.at(cover, starts[same], 1)
                np.add.at(cover, starts[same] + t, -1)
                pairs = np.unique(np.stack([owner[starts[same]], slot[same]]), axis=1)
                for r, s in pairs.T.tolist():
                    items[r].update(owners[s])
        return offsets, (np.cumsum(cover[:-1]) > 0)[at], items


def window_hash_rows(ids: np.ndarray) -> np.ndarray:
    """``window_hash`` of each row as one window."""
    t = ids.shape[1]
    flat = window_hash(mix(ids.astype(np.uint64).ravel()), t)
    return flat[::t]


def blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in parts whose text is about block_bytes at most."""
    size = benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    n = max(1, -(-int(size) // block_bytes))
    part = F.pmod(F.xxhash64(F.col("text")), F.lit(n))
    return [benchmark.where(part == b) for b in range(n)] if n > 1 else [benchmark]


def contaminated_words(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM,
                       block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: row (the document, all columns), text, hit (a byte for each word, 1 if hit) and items
    (sorted, as strings).

    Each block of the benchmark is one pass over all documents that adds to hit and items.
    """
    out = docs.select(F.struct("*").alias("row"), "text", F.lit(None).cast("binary").alias("hit"),
                      F.lit(None).cast("array<string>").alias("items"))
    parts = blocks(benchmark.select("item_id", "text"), block_bytes)
    for i, part in enumerate(parts):
        out = (materialise(out) if i else out).mapInArrow(_matcher(_index(part, span, gram)), out.schema)
    return out


def _index(part: DataFrame, span: int, gram: int):
    rows = part.select(F.col("item_id").cast("string"), "text").toPandas()
    ids, texts = ([x if isinstance(x, str) else None for x in rows[c].tolist()] for c in ("item_id", "text"))
    return part.sparkSession.sparkContext.broadcast(BenchmarkIndex(ids, texts, span, gram))


def _matcher(index):
    def match(batches):
        for b in chunks(batches):
            found = index.value
            offsets, hit, items = found.match(b.column("text"))
            hits, named = [], []
            for r, (old, before) in enumerate(zip(b.column("hit").to_pylist(), b.column("items").to_pylist())):
                new = hit[offsets[r]:offsets[r + 1]].astype(np.uint8)
                hits.append((new | np.frombuffer(old, np.uint8) if old else new).tobytes())
                named.append(sorted(({found.items[i] for i in items[r]} - {None}).union(before or ())))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("text"), pa.array(hits, pa.binary()),
                                              pa.array(named, pa.list_(pa.string()))], names=b.schema.names)
    return match


def n_hit(hit: str):
    """How many bytes of the column are 1: the zero bytes are removed as characters."""
    return F.length(F.replace(F.decode(F.col(hit), "ISO-8859-1"), F.lit("\0"), F.lit(""))).cast("long")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.length("hit").cast("long").alias("n_words"), n_hit("hit").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_hit("hit") > 0).alias("contaminated"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contaminated_words(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark")))


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document rows without a hit word, all columns kept."""
    found = contaminated_words(docs, read(spark, sf_dir, "benchmark"))
    return found.where(n_hit("hit") == 0).select("row.*")


_WORDS = """regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"""

#: Windows of every length that items have, spelled out and joined as texts.
OP10_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, t, array_to_string(w[s:s + t - 1], ' ') AS win FROM (
    SELECT item, w, least(10, len(w)) AS t, unnest(range(1, CAST(len(w) - least(10, len(w)) + 2 AS BIGINT))) AS s
    FROM i WHERE len(w) > 0)),
dw AS (SELECT r, t, s, array_to_string(w[s:s + t - 1], ' ') AS win FROM (
    SELECT r, w, t, unnest(range(1, CAST(len(w) - t + 2 AS BIGINT))) AS s
    FROM d, (SELECT DISTINCT t FROM iw) WHERE len(w) >= t)),
m AS (SELECT dw.r, dw.s, dw.t, iw.item FROM dw JOIN iw USING (t, win)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + t)) AS p FROM
    (SELECT DISTINCT r, s, t FROM m)) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM
    (SELECT DISTINCT r, item FROM m WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""
