"""Repeated byte strings, within and across documents, by a common-prefix-aware distributed merge sort of suffixes.

Every ``LENGTH``-byte window has an anchor: its first ``GRAM``-byte string of smallest hash. Equal windows have their
anchors at the same place, so it is enough to sort the suffixes that start at anchors (about one in 90 bytes), each with
the bytes before it up to the first window that has this anchor.

1. Anchors' grams are counted by hash; a window whose gram occurs once can't be repeated and goes no further.
2. Each chunk of documents sorts the suffixes at its remaining anchors and sends, per key range, one front-coded run: the
   length of the prefix shared with the suffix before, then the rest (the bytes before the anchor likewise, backwards).
   The sort key starts with the gram's 64-bit hash, so equal ranges of it are equally full without sampling.
3. Each range merges its runs with a loser tree that keeps every head's common prefix with the last suffix taken: heads
   are compared by these lengths alone unless they are equal, and then only beyond them; known prefixes are never read
   again. The lengths that fall out are the common prefix array.
4. A window whose part behind the anchor is longer than the longest common prefix with a neighbour is unique; of the
   others equal ones are counted by their bytes (suffixes that agree backwards too are one entry with a count).

Grams that occur more than ``HOT`` times (a passage in very many documents, each in other surroundings) are split by
content before the sort: windows with their anchor at places 8 j to 8 j + 7 take the bytes they all share as their key.
Windows are judged on the input; removed is every byte covered by a window that also starts elsewhere.

Defined cases: null and empty texts have no bytes; texts under LENGTH bytes have no window; repeated rows repeat each
other; no document group is special, copies are merged as equal entries.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from dealscreen.llm.common import (give_back, materialise, mix, pack, read, returned, shuffle_partitions, sliding_min, unpack)
from dealscreen.llm.substrings import packed_chunks

LENGTH, GRAM, HOT, BLOCK = 200, 24, 4096, 8
#: Bytes whose anchors are looked for at once (a longer text alone): that takes about a hundred times as much.
PART = 1 << 19
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes one after the other, and where each text starts."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.string())])
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    return np.frombuffer(data if data is not None else b"", np.uint8), offsets


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """first, last, anchor, name: windows that start at first..last have this anchor; name is its gram's hash.

    Windows lie in one text, so whole texts are taken, ``PART`` bytes at a time.
    """
    out, a = [], 0
    while a < len(offsets) - 1:
        z = max(a + 1, int(np.searchsorted(offsets, offsets[a] + PART, side="right")) - 1)
        start = offsets[a]
        *places, name = _anchors(data[start:offsets[z]], offsets[a:z + 1] - start)
        out.append([*(x + start for x in places), name])
        a = z
    return tuple(np.concatenate(x) for x in zip(*out)) if out else _anchors(data, offsets)


def _anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    empty = (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    if len(data) < LENGTH:
        return empty
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, strides=(1,))
    n = len(data) - GRAM + 1
    h = mix(words[:n] * _M[0] + words[8:n + 8] * _M[1] + words[16:n + 16] * _M[2])
    wide = LENGTH - GRAM + 1
    low = sliding_min(h, wide)  # of the window at x: grams x to x + wide - 1
    x = np.arange(len(low))
    doc = np.searchsorted(offsets, x, side="right") - 1
    inside = x + LENGTH <= offsets[1:][doc]
    # Grams that are smallest in some window.
    top = np.concatenate([np.zeros(wide - 1, np.uint64), low, np.zeros(wide - 1, np.uint64)])
    least = np.flatnonzero(h <= ~sliding_min(~top, wide))
    change = np.flatnonzero((low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])) + 1
    first = np.concatenate([[0], change])
    last = np.concatenate([change - 1, [len(low) - 1]])
    own = inside[first]
    first, last = first[own], last[own]
    out = []
    while len(first):
        slot = np.searchsorted(least, first)
        while (other := h[least[slot]] != low[first]).any():
            slot[other] += 1
        anchor = least[slot]
        end = np.minimum(last, anchor)  # beyond its anchor a run of equal hashes goes on with the next one
        out.append((first, end, anchor, mix(low[first])))  # minima are small: hashed again, the ranges are equally full
        more = last > anchor
        first, last = anchor[more] + 1, last[more]
    if not out:
        return empty
    first, last, anchor, name = (np.concatenate(c) for c in zip(*out))
    order = np.argsort(first, kind="stable")
    return first[order], last[order], anchor[order], name[order]


_COUNT = "bucket int, chunk long, h binary, at binary"


def _count_grams(buckets: int):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                name = anchors(*_bytes_of(b.column("texts").slice(r, 1).flatten()))[3]
                if not len(name):
                    continue
                bucket = (name % np.uint64(buckets)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
                rows = [(i, pack(name[o]), pack(np.diff(o, prepend=0).astype(np.uint32)))
                        for i in range(buckets) if len(o := order[cuts[i]:cuts[i + 1]])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in rows], pa.int32()), pa.array([b.column("chunk")[r].as_py()] * len(rows), pa.int64()),
                     pa.array([x[1] for x in rows], pa.binary()), pa.array([x[2] for x in rows], pa.binary())],
                    names=["bucket", "chunk", "h", "at"])

    return run


def _repeated_grams(hot: int):
    def run(table: pa.Table) -> pa.Table:
        names = [unpack(x, np.uint64) for x in table["h"].to_pylist()]
        ends = np.cumsum([len(x) for x in names])
        _, inverse, counts = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
        n = counts[inverse]
        out = []
        for chunk, at, a, z in zip(table["chunk"].to_pylist(), table["at"].to_pylist(), np.append(0, ends[:-1]), ends):
            k = n[a:z] > 1
            if k.any():
                place = np.cumsum(unpack(at, np.uint32), dtype=np.int64)[k]
                out.append((chunk, pack(np.diff(place, prepend=0).astype(np.uint32)), pack((n[a:z][k] > hot).astype(np.uint8))))
        return pa.table([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()),
                         pa.array([x[2] for x in out], pa.binary())], names=["chunk", "at", "hot"])

    return run


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known to agree."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return n - (x.bit_length() + 7) // 8


def front_code(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    shared, rest, last = [], [], b""
    for s in strings:
        n = common_prefix(last, s)
        shared.append(n)
        rest.append(s[n:])
        last = s
    return shared, rest


def front_decode(shared, rest) -> list[bytes]:
    out, last = [], b""
    for n, r in zip(shared, rest):
        last = last[:n] + r
        out.append(last)
    return out


def _zipped(strings: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(strings))


def _unzipped(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def _lists(*columns) -> bytes:
    return pack(np.array(columns, np.uint32).reshape(-1))


_RUN = "bucket int, chunk long, n int, numbers binary, places binary, behind binary, before binary"


def _entries(data: bytes, first: int, last: int, anchor: int, name: int, hot: bool):
    """(key, first, last, anchor) under which an anchor's windows are compared; several if its gram is hot."""
    if not hot:
        yield name, first, last
        return
    for j in range((anchor - last) // BLOCK, (anchor - first) // BLOCK + 1):
        a, z = max(first, anchor - BLOCK * j - BLOCK + 1), min(last, anchor - BLOCK * j)
        shared = data[anchor - BLOCK * j:anchor - BLOCK * j + LENGTH - BLOCK + 1]
        yield xxhash.xxh64_intdigest(shared, j), a, z


def _send_runs(buckets: int):
    width = -(-2**64 // buckets)

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                whole, offsets = _bytes_of(b.column("texts").slice(r, 1).flatten())
                first, last, anchor, name = anchors(whole, offsets)
                data = whole.tobytes()
                chosen = [(np.cumsum(unpack(x["at"], np.uint32), dtype=np.int64), unpack(x["hot"], np.uint8))
                          for x in b.column("found")[r].as_py()]
                at, hot = (np.concatenate(c) for c in zip(*chosen))
                keys, places = array("Q", name[at[hot == 0]].tobytes()), [array("q", x[at[hot == 0]].tobytes()) for x in (first, last, anchor)]
                for f, z, a, h in zip(*(x[at[hot > 0]].tolist() for x in (first, last, anchor, name))):
                    for key, x0, x1 in _entries(data, f, z, a, h, True):
                        keys.append(key)
                        for x, v in zip(places, (x0, x1, a)):
                            x.append(v)
                del first, last, anchor, name
                key = np.frombuffer(keys, np.uint64)
                bucket = (key // np.uint64(width)).astype(np.int32)
                order = np.argsort(bucket, kind="stable")
                cuts, rows = np.searchsorted(bucket[order], np.arange(buckets + 1)), []
                for i in np.flatnonzero(np.diff(cuts)).tolist():  # a range's strings at a time
                    own = order[cuts[i]:cuts[i + 1]]
                    x0, x1, a = (np.frombuffer(x, np.int64)[own].tolist() for x in places)
                    part = sorted((k.to_bytes(8, "big") + data[m:y + LENGTH], x, m) for k, x, y, m in zip(key[own].tolist(), x0, x1, a))
                    shared, rest = front_code([e[0] for e in part])
                    back, more = front_code([data[x:m][::-1] for _, x, m in part])
                    rows.append((i, len(part), _lists(shared, [len(x) for x in rest], back, [len(x) for x in more]),
                                 _lists([e[1] for e in part]), _zipped(rest), _zipped(more)))
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in rows], pa.int32()), pa.array([b.column("chunk")[r].as_py()] * len(rows), pa.int64()),
                         pa.array([x[1] for x in rows], pa.int32()), *[pa.array([x[i] for x in rows], pa.binary()) for i in (2, 3, 4, 5)]],
                        names=["bucket", "chunk", "n", "numbers", "places", "behind", "before"])

    return run


def merge_runs(runs: list[tuple[list[int], list[bytes]]]):
    """Merge front-coded sorted runs: yields (run, place in the run, string, common prefix with the one before).

    Loser tree: a node holds the run that lost there and how long its head's prefix shared with the last string taken is.
    Of two heads the one that shares more is smaller; equal lengths are compared beyond them, and the loser keeps what
    that showed.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    heads: list = [None] * size
    place, known = [0] * size, [0] * size
    for i, (shared, rest) in enumerate(runs):
        if rest:
            heads[i] = rest[0]

    def smaller(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs; sets the loser's common prefix with the winner."""
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = common_prefix(x, y, known[a])
        first = len(x) == n or (len(y) > n and x[n] < y[n])
        win, lose = (a, b) if first else (b, a)
        known[lose] = n
        return win, lose

    losers, winners = [0] * size, list(range(size))
    level = winners
    base = size
    while len(level) > 1:
        base //= 2
        up = []
        for i in range(0, len(level), 2):
            win, lose = smaller(level[i], level[i + 1])
            losers[base + i // 2] = lose
            up.append(win)
        level = up
    win = level[0]
    while heads[win] is not None:
        s = heads[win]
        yield win, place[win], s, known[win]
        shared, rest = runs[win]
        place[win] += 1
        i = place[win]
        if i < len(rest):
            known[win] = shared[i]
            heads[win] = s[:shared[i]] + rest[i]
        else:
            heads[win] = None
        node = (size + win) // 2
        while node:
            win, losers[node] = smaller(win, losers[node])
            node //= 2


class _Strings:
    """Strings that lie one after the other; each is cut out when it is asked for."""

    def __init__(self, joined: bytes, sizes: np.ndarray):
        self.joined, self.ends = joined, array("q", np.append(0, np.cumsum(sizes, dtype=np.int64)).tobytes())

    def __len__(self) -> int:
        return len(self.ends) - 1

    def __getitem__(self, i: int) -> bytes:
        return self.joined[self.ends[i]:self.ends[i + 1]]


def _group_windows(counts: dict, reach: dict) -> dict:
    """The first places and numbers of repeated windows of every distinct (before, behind) with one key.

    counts: how often each occurs; reach: the longest common prefix of its ``behind`` with another entry's.
    """
    if len(counts) == 1:
        (before, behind), n = next(iter(counts.items()))
        return {(before, behind): [(0, len(before) + len(behind) - LENGTH + 1)]} if n > 1 else {}
    seen: dict[bytes, int] = {}
    for (before, behind), n in counts.items():
        whole = before + behind
        # The window at i has LENGTH - (len(before) - i) bytes from its anchor on; more than reach of them are unique.
        for i in range(min(len(whole) - LENGTH, len(before) - LENGTH + reach[before, behind]) + 1):
            w = whole[i:i + LENGTH]
            seen[w] = seen.get(w, 0) + n
    spans = {}
    for before, behind in counts:
        whole, own = before + behind, []
        stop = min(len(whole) - LENGTH, len(before) - LENGTH + reach[before, behind]) + 1
        for i in range(stop):
            if seen[whole[i:i + LENGTH]] > 1:
                if own and own[-1][0] + own[-1][1] == i:
                    own[-1][1] += 1
                else:
                    own.append([i, 1])
        if own:
            spans[before, behind] = own
    return spans


def _merge(table: pa.Table) -> pa.Table:
    """Merge a range's runs and find its repeated windows: chunk, first places and numbers.

    Of a run the joined strings and lists of numbers are held; of a key's entries each distinct string once.
    """
    runs, places, backs, chunks = [], [], [], table["chunk"].to_pylist()
    for n, numbers, at, behind, before in zip(*(table[c] for c in ("n", "numbers", "places", "behind", "before"))):
        shared, sizes, back, more = unpack(numbers.as_py(), np.uint32).reshape(4, n.as_py())
        runs.append((array("I", shared.tobytes()), _Strings(_unzipped(behind.as_py()), sizes)))
        backs.append((array("I", back.tobytes()), _Strings(_unzipped(before.as_py()), more)))
        places.append(array("I", unpack(at.as_py(), np.uint32).tobytes()))
    found: dict[int, tuple[array, array]] = {}
    last = [b""] * len(runs)  # of each run: what stands before its last entry, backwards
    group: dict[tuple[bytes, bytes], array] = {}  # runs and places of each distinct entry
    reach, key, pair = {}, None, None

    def close():
        for x, spans in (_group_windows({x: len(v) // 2 for x, v in group.items()}, reach) if pair else {}).items():
            own = group[x]
            for run, place in zip(own[::2], own[1::2]):
                starts, numbers = found.setdefault(chunks[run], (array("I"), array("I")))
                for a, n in spans:
                    starts.append(place + a)
                    numbers.append(n)

    for run, i, s, known in merge_runs(runs):
        shared, more = backs[run]
        last[run] = last[run][:shared[i]] + more[i]
        if s[:8] != key:
            close()
            group, reach, key, pair, known = {}, {}, s[:8], None, 8
        common, before = max(known - 8, 0), pair
        pair = (last[run][::-1], s[8:])
        group.setdefault(pair, array("I")).extend((run, places[run][i]))
        for x in (before, pair):
            if x is not None:
                reach[x] = max(common, reach.get(x, 0))
    close()
    out = pa.table([pa.array(list(found), pa.int64()), pa.array([_lists(*v) for v in found.values()], pa.binary())],
                   names=["chunk", "spans"])
    del runs, backs, places, found, last, group
    give_back()
    return out


def repeated_windows(chunks: DataFrame, hot: int = HOT) -> DataFrame:
    """chunk and spans (first places and numbers of repeated windows) by key range."""
    spark = chunks.sparkSession
    buckets = 2 * shuffle_partitions(spark)
    grams = materialise(chunks.select("chunk", "texts").mapInArrow(returned(_count_grams(buckets)), _COUNT)
                        .groupBy("bucket").applyInArrow(_repeated_grams(hot), "chunk long, at binary, hot binary"))
    chosen = grams.groupBy("chunk").agg(F.collect_list(F.struct("at", "hot")).alias("found"))
    runs = chunks.join(chosen, "chunk").select("chunk", "texts", "found").mapInArrow(returned(_send_runs(buckets)), _RUN)
    out = materialise(runs.groupBy("bucket").applyInArrow(_merge, "chunk long, spans binary"))
    return out


def _assemble(batches):
    for b in batches:
        for r in range(b.num_rows):
            data, offsets = _bytes_of(b.column("texts").slice(r, 1).flatten())
            cover = np.zeros(len(data) + 1, np.int32)
            for x in b.column("found")[r].as_py() or ():
                first, n = unpack(x, np.uint32).reshape(2, -1).astype(np.int64)
                np.add.at(cover, first, 1)
                np.add.at(cover, first + n - 1 + LENGTH, -1)
            gone = np.cumsum(cover[:-1], out=cover[:-1]) > 0
            del cover
            n_removed = np.array([np.count_nonzero(gone[a:z]) for a, z in zip(offsets[:-1], offsets[1:])], np.int64)
            spans, hashes = [], []
            for a, z, n in zip(offsets[:-1], offsets[1:], n_removed):
                own = gone[a:z]
                spans.append(int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0)
                hashes.append(hashlib.sha256((data[a:z][~own] if n else data[a:z]).tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("ids").slice(r, 1).flatten(), pa.array(np.diff(offsets)), pa.array(n_removed),
                 pa.array(spans, pa.int64()), pa.array(hashes, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def deduplicated(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document row."""
    chunks = packed_chunks(docs, buckets=shuffle_partitions(docs.sparkSession))
    found = repeated_windows(chunks, hot).groupBy("chunk").agg(F.collect_list("spans").alias("found"))
    return chunks.join(found, "chunk", "left").select("ids", "texts", "found").mapInArrow(
        returned(_assemble), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicated(read(spark, sf_dir, "documents").select("doc_id", "text"))
