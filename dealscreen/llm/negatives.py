"""Hard negatives by an inverted multi-index: cells of two half-space codebooks, visited by score bounds until certified.

1. Vectors become integers (floor of ``SCALE`` times each component). Each half of the vector has its own codebook,
   fitted on at most ``SAMPLE`` rows (the smallest hashes of all rows' numbers); every row of the table is indexed: its
   cell is the pair of its halves' nearest codewords. Per cell the largest distances of a row (its radii) are kept.
2. The score of a query with any row of cell (i, j) is at most q1.c_i + q2.c_j and the lesser of |q1| r1 + |q2| r2 and |q| r,
   the cell's radii of either half and of whole vectors. The at most ``CODES``^2 sums are sorted: cells by falling bound.
3. A query asks for scores in windows [low, high], the best k of each. It visits cells until their rows number
   ``FIRST``, then ``GROWTH`` times as many, then all; it stops where the next bound lies below what every window still
   can use (its low end, or its k-th best score so far): then the windows are certified and exact.
4. A cell's rows lie in blocks of ``BLOCK`` rows, so a cell with a third of all rows is many blocks; blocks that follow
   each other are a bucket of about ``BUCKET`` components. A request goes to a bucket with up to ``GROUP`` queries, each
   sent there once with one bit for each cell. A bucket scores each block as products of matrices with the queries that
   want its cell, raises windows' low ends by what it has found, and sends back at most k rows a query and window.

``mine`` searches positives (one open window, the same label) and then the negatives (a window for each positive, other labels).

What reaches the driver: the sample, two codebooks, radii and the row counts of at most ``CODES``^2 cells, all bounded.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part; a null vec_id is no
anchor and larger than every other; shorter vectors count as if they ended in zeros; components beyond ``LIMIT``
after scaling are held there; repeated rows are rows of their own; an empty table has no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from dealscreen.llm.common import discard, give_back, materialise, pack, read, returned, scratch_dir, shuffle_partitions, unpack

SCALE, LIMIT = 256, 1 << 22
#: Rows that the codebooks are fitted on at most, codewords a half at most, rows a cell aimed at, rounds of fitting.
SAMPLE, CODES, CELL_ROWS, FITS = 1 << 14, 64, 64, 8
#: Rows a block, queries a request; rows visited in the first round, and their growth in the second.
BLOCK, GROUP, FIRST, GROWTH = 2048, 256, 1024, 8
#: Components of a bucket's vectors; scores, and found rows, held at once there.
BUCKET, SCORES, FOUND = 1 << 21, 1 << 19, 1 << 20
POSITIVES, NEGATIVES, LOW, HIGH = 5, 3, 50, 95
_OPEN = 1 << 62


def vectors(table: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """row, id, label, v (integers) of the rows that take part."""
    x = F.transform(F.col(vector), lambda e: e.cast("double"))
    good = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    held = F.transform(x, lambda e: F.least(F.greatest(F.floor(e * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    return (table.where(F.col(label).isNotNull() & F.col(vector).isNotNull() & good)
            .select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                    F.col(label).cast("long").alias("label"), held.alias("v")))


def _matrix(lists: pa.Array, dims: int) -> np.ndarray:
    """Integer lists as rows of a matrix, short ones filled up with zeros."""
    lists = pa.concat_arrays([lists])
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(-1, dims).astype(np.int32)
    out, at = np.zeros((len(sizes), dims), np.int32), 0
    for i, n in enumerate(sizes.tolist()):
        out[i, :n] = flat[at:at + n]
        at += n
    return out


def _nearest(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and distance of the nearest codeword."""
    code = np.argmin((codebook ** 2).sum(1) - 2 * (x @ codebook.T), axis=1)
    return code, np.sqrt(((x - codebook[code]) ** 2).sum(1))


def codebook(x: np.ndarray, codes: int, fits: int = FITS) -> np.ndarray:
    """Centres of the sample's rows (Lloyd's iterations from evenly spaced distinct rows)."""
    x = x.astype(np.float64)
    distinct = np.unique(x, axis=0)
    centres = distinct[np.linspace(0, len(distinct) - 1, min(codes, len(distinct))).astype(int)]
    for _ in range(fits):
        code, _ = _nearest(x, centres)
        n = np.bincount(code, minlength=len(centres))
        total = np.stack([np.bincount(code, weights=column, minlength=len(centres)) for column in x.T], axis=1) if x.shape[1] else centres
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centres)
    return centres


@dataclass(frozen=True)
class Index:
    """Blocks of all rows by cell, and the bounded parts that every query needs to order the cells."""

    blocks: DataFrame
    dims: int
    halves: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray, np.ndarray]  # by cell: of the halves and of whole vectors
    counts: np.ndarray  # rows by cell
    block: int
    buckets: int

    def parts(self) -> np.ndarray:
        return -(-self.counts // self.block)

    def ranges(self) -> tuple[np.ndarray, np.ndarray]:
        """Each bucket's first cell, and the one after its last (a cell of several blocks may be in more than one)."""
        parts = self.parts()
        cell = np.repeat(np.arange(len(parts)), parts)
        bucket = _bucket_of(self.counts, parts, self.buckets)
        at = np.arange(self.buckets)
        if not len(cell):
            return at * 0, at * 0
        first, last = np.searchsorted(bucket, at), np.searchsorted(bucket, at, side="right")
        low, high = (cell[np.minimum(x, len(cell) - 1)] for x in (first, np.maximum(last, 1) - 1))
        return np.where(last > first, low, 0), np.where(last > first, high + 1, 0)


def _bucket_of(counts: np.ndarray, parts: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of every block, in the order of cells and parts: they rise, and are equally full."""
    size = np.repeat(counts / np.maximum(parts, 1), parts)
    before = np.cumsum(size) - size
    return np.minimum(before * (buckets / max(size.sum(), 1)), buckets - 1).astype(np.int64)


_INDEXED = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int32())),
                      ("a", pa.int32()), ("b", pa.int32()), ("da", pa.float64()), ("db", pa.float64())])
_BLOCKS = pa.schema([("bucket", pa.int64()), ("cell", pa.int64()), ("rows", pa.binary()), ("ids", pa.list_(pa.int64())),
                     ("labels", pa.binary()), ("matrix", pa.binary())])


def _block(dims: int, first: np.ndarray, bucket: np.ndarray):
    """A block, in the order of its labels. first: the number of each cell's first block; bucket: by number."""
    def made(group: pa.Table) -> pa.Table:
        group = group.sort_by([("label", "ascending"), ("row", "ascending")])
        cell, part = group["cell"][0].as_py(), group["part"][0].as_py()
        rows, labels = (pack(group[c].to_numpy()) for c in ("row", "label"))
        matrix = pack(_matrix(group["v"].combine_chunks(), dims).ravel())
        return pa.Table.from_pylist([{"bucket": int(bucket[first[cell] + part]), "cell": cell, "rows": rows,
                                      "ids": group["id"].to_pylist(), "labels": labels, "matrix": matrix}], _BLOCKS)

    return made


def build(rows: DataFrame, codes: int = CODES, sample: int = SAMPLE, cell_rows: int = CELL_ROWS, block: int = BLOCK) -> Index | None:
    """The index over all rows of ``vectors`` (a written table); None if there are none."""
    n, dims = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return None
    dims = max(1, dims)
    block = max(1, min(block, (1 << 20) // dims))
    taken = rows.select("row", "v").orderBy(F.xxhash64("row"), "row").limit(sample).toArrow()
    x, cut = _matrix(taken["v"].combine_chunks(), dims), dims // 2
    codes = int(max(1, min(codes, np.ceil(np.sqrt(n / cell_rows)))))
    halves = codebook(x[:, :cut], codes), codebook(x[:, cut:], codes)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("v"), dims).astype(np.float64)
            (i, di), (j, dj) = _nearest(m[:, :cut], halves[0]), _nearest(m[:, cut:], halves[1])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("row", "id", "label")), b.column("v").cast(pa.list_(pa.int32())),
                                              pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(di), pa.array(dj)], schema=_INDEXED)

    path = scratch_dir(rows.sparkSession)
    placed = materialise(rows.mapInArrow(returned(assign), from_arrow_schema(_INDEXED)), path)
    width = len(halves[1])
    placed = placed.withColumn("cell", F.col("a").cast("long") * width + F.col("b"))
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("da").alias("da"), F.max("db").alias("db"),
                                       F.max(F.hypot("da", "db")).alias("d")).collect()
    counts = np.zeros(len(halves[0]) * width, np.int64)
    radii = tuple(np.zeros((len(halves[0]), width)) for _ in range(3))
    for c in cells:
        counts[c.cell] = c.n
        for r, own in zip(radii, (c.da, c.db, c.d)):
            r.flat[c.cell] = own
    n_parts = -(-counts // block)
    buckets = int(max(1, min(n_parts.sum(), max(shuffle_partitions(rows.sparkSession), -(-n * dims // BUCKET)))))
    parts = F.element_at(F.array(*[F.lit(int(p)) for p in np.maximum(1, n_parts)]), (F.col("cell") + 1).cast("int"))
    blocks = materialise(placed.withColumn("part", F.pmod(F.xxhash64("row"), parts.cast("long"))).select("row", "id", "label", "v", "cell", "part")
                         .groupBy("cell", "part").applyInArrow(
                             _block(dims, np.cumsum(n_parts) - n_parts, _bucket_of(counts, n_parts, buckets)), from_arrow_schema(_BLOCKS)))
    discard(rows.sparkSession, path)
    return Index(blocks, dims, halves, radii, counts, block, buckets)


def falling_cells(q: np.ndarray, halves, radii, least: float = -np.inf, counts: np.ndarray | None = None, rows: float = np.inf) -> np.ndarray:
    """The cells by falling bound, as (bound, cell), whose bound is ``least`` or more and before which lie less than ``rows`` rows.

    radii: of each half by its codewords or by cell; then, if given, of the whole vectors by cell. Equal bounds fall by cell.
    """
    cut = halves[0].shape[1]
    a, b = halves[0] @ q[:cut], halves[1] @ q[cut:]
    one, two = q[:cut] @ q[:cut], q[cut:] @ q[cut:]
    reach = np.sqrt(one) * radii[0].reshape(len(a), -1) + np.sqrt(two) * radii[1]
    if len(radii) > 2:
        reach = np.minimum(reach, np.sqrt(one + two) * radii[2])
    # Scores are whole numbers: half a point, and a share of large ones, covers what the bound's floats may lack.
    bound = (a[:, None] + b + reach).ravel() + (0.5 + 1e-12 * (np.abs(a).max() + np.abs(b).max() + reach.max()))
    cell, most = np.flatnonzero(bound >= least), 64
    while True:
        taken = cell
        if rows < np.inf and most < len(cell):
            taken = cell[bound[cell] >= np.partition(bound[cell], len(cell) - most)[len(cell) - most]]
        taken = taken[np.argsort(-bound[taken], kind="stable")]
        if rows < np.inf:
            covered = np.cumsum(counts[taken])
            if len(taken) < len(cell) and covered[-1] < rows:
                most *= 8
                continue
            taken = taken[covered - counts[taken] < rows]
        out = np.empty(len(taken), [("bound", float), ("cell", np.int64)])
        out["bound"], out["cell"] = bound[taken], taken
        return out


_REQUESTS = pa.schema([("bucket", pa.int64()), *[(x, pa.binary()) for x in ("q_rows", "q_labels", "q_matrix", "low", "high", "wants")]])


def _requests(index: Index, skip: int, budget: float):
    """Requests of queries (row, label, v, low, high, best) to the buckets of the cells they visit in this round."""
    dims, halves, radii, counts, (first, end) = index.dims, index.halves, index.radii, index.counts, index.ranges()

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, GROUP):
                b = batch.slice(start, GROUP)
                m, wants = _matrix(b.column("v"), dims), np.zeros((b.num_rows, len(counts)), bool)
                rows, labels = (b.column(c).to_numpy() for c in ("row", "label"))
                highs = b.column("high").to_pylist()
                # What each window can still use: its low end, or the k-th best so far.
                lows = [[max(x, y) for x, y in zip(low, best)] for low, best in zip(b.column("low").to_pylist(), b.column("best").to_pylist())]
                for i, (low, high) in enumerate(zip(lows, highs)):
                    least = min((x for x, y in zip(low, high) if x <= y), default=None)
                    if least is None:
                        continue
                    cell = falling_cells(m[i].astype(np.float64), halves, radii, least, counts, budget)["cell"]
                    wants[i, cell[np.cumsum(counts[cell]) - counts[cell] >= skip]] = True
                wants &= counts > 0
                width, out = max(map(len, highs), default=0), []
                low = np.array([x + [1] * (width - len(x)) for x in lows], np.int64).reshape(-1, width)
                high = np.array([x + [0] * (width - len(x)) for x in highs], np.int64).reshape(-1, width)
                for bucket, (a, z) in enumerate(zip(first, end)):
                    who = np.flatnonzero(wants[:, a:z].any(axis=1))
                    if len(who):
                        out.append([bucket, *map(pack, (rows[who], labels[who], m[who].ravel(), low[who].ravel(), high[who].ravel(),
                                                        np.packbits(wants[who, a:z])))])
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), _REQUESTS)], schema=_REQUESTS)

    return request


_FOUND = pa.schema([("row", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("found", pa.int64())])


def _products(x: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
    """Exact scores. most: no sum of products' sizes, and so no part of it, is larger."""
    for kind, limit in ((np.float32, 2.0 ** 24), (np.float64, 2.0 ** 53)):
        if most < limit * 0.999:
            return x.astype(kind) @ q.astype(kind).T
    return x.astype(np.int64) @ q.astype(np.int64).T


def _best(found: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k of each query and window of what was found (a column each: query, window, score, place), and the k-th ones."""
    q, w, score, at = found
    found = found[:, np.lexsort((rows[at], ids[at], unnamed[at], -score, w, q))]
    head = np.flatnonzero(np.append(True, (found[:2, 1:] != found[:2, :-1]).any(axis=0)))
    rank = np.arange(found.shape[1]) - np.repeat(head, np.diff(np.append(head, found.shape[1])))
    return found[:, rank < k], found[:, rank == k - 1]


def _score(dims: int, k: int, same_label: bool, first: np.ndarray, end: np.ndarray):
    """The best k rows of a bucket in each window of each query that asks it. first, end: each bucket's cells."""
    def score(requests: pa.Table, blocks: pa.Table) -> pa.Table:
        if not requests.num_rows or not blocks.num_rows:
            return _FOUND.empty_table()
        bucket = blocks["bucket"][0].as_py()
        cells = end[bucket] - first[bucket]
        q_rows, q_labels = ([unpack(x, np.int64) for x in requests[c].to_pylist()] for c in ("q_rows", "q_labels"))
        n = [len(x) for x in q_rows]
        q = np.concatenate([unpack(x, np.int32) for x in requests["q_matrix"].to_pylist()]).reshape(-1, dims)
        wants = np.concatenate([np.unpackbits(unpack(x, np.uint8), count=i * cells).reshape(i, cells)
                                for i, x in zip(n, requests["wants"].to_pylist())])
        ends = [[unpack(x, np.int64).reshape(i, -1) for i, x in zip(n, requests[c].to_pylist())] for c in ("low", "high")]
        width = max(x.shape[1] for x in ends[0])
        low, high = (np.concatenate([np.pad(x, ((0, 0), (0, width - x.shape[1])), constant_values=v) for x in part]) for part, v in zip(ends, (1, 0)))
        order = np.argsort(np.concatenate(q_labels), kind="stable")
        q_rows, q_labels, q, wants, low, high = (x[order] for x in (np.concatenate(q_rows), np.concatenate(q_labels), q, wants, low, high))
        del ends, requests
        norms, wants = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)), np.ascontiguousarray(wants.T)
        least = np.where(low <= high, low, _OPEN).min(axis=1)  # what a query can use at all
        ids = pa.concat_arrays([x.flatten() for x in blocks["ids"].chunks])
        rows, labels = ([unpack(x, np.int64) for x in blocks[c].to_pylist()] for c in ("rows", "labels"))
        every, base = np.concatenate(rows), np.cumsum([0, *map(len, rows)])
        unnamed, named = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        kept, total = [], 0
        for place, cell, own_rows, own_labels, matrix in zip(base, blocks["cell"].to_pylist(), rows, labels, blocks["matrix"]):
            who = np.flatnonzero(wants[cell - first[bucket]])
            if not len(who):
                continue
            x = unpack(matrix.as_py(), np.int32).reshape(-1, dims)
            size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
            # Rows lie by label, and so do queries.
            spans = [(0, len(x), who)]
            if same_label:
                label, a = np.unique(own_labels, return_index=True)
                spans = [(i, j, who[slice(*np.searchsorted(q_labels[who], (v, v + 1)))]) for v, i, j in zip(label, a, np.append(a[1:], len(x)))]
            for a, z, asks in spans:
                step = max(1, SCORES // (z - a))
                for i in range(0, len(asks), step):
                    own = asks[i:i + step]
                    s = _products(x[a:z], q[own], size[a:z].max() * norms[own].max())
                    limit = {"float32": 2**24, "float64": 2**53}.get(s.dtype.name, _OPEN)  # beyond every score
                    edge = np.clip(least[own], -limit, limit).astype(s.dtype)
                    at, of = np.divmod(np.flatnonzero(s >= edge), len(own))
                    got, of, at = s[at, of].astype(np.int64), own[of], at + a
                    good = (own_rows[at] != q_rows[of]) & (same_label | (own_labels[at] != q_labels[of]))
                    got, of, at = got[good], of[good], at[good]
                    made = []
                    for w in range(width):
                        hit = np.flatnonzero((low[of, w] <= got) & (got <= high[of, w]))
                        made.append(np.stack([of[hit], np.full(len(hit), w), got[hit], at[hit] + place]))
                    made = np.concatenate(made, axis=1)
                    if made.size:
                        made, kth = _best(made, named, unnamed, every, k)
                        low[kth[0], kth[1]] = np.maximum(low[kth[0], kth[1]], kth[2])
                        least[kth[0]] = np.where(low[kth[0]] <= high[kth[0]], low[kth[0]], _OPEN).min(axis=1)
                        kept, total = [*kept, made], total + made.shape[1]
                if total > FOUND:
                    kept = [_best(np.concatenate(kept, axis=1), named, unnamed, every, k)[0]]
                    total = min(kept[0].shape[1], FOUND // 2)
        give_back()
        if not kept:
            return _FOUND.empty_table()
        of, w, got, at = _best(np.concatenate(kept, axis=1), named, unnamed, every, k)[0]
        return pa.Table.from_arrays([pa.array(q_rows[of]), pa.array(w, pa.int32()), pa.array(got), ids.take(pa.array(at)), pa.array(every[at])], schema=_FOUND)

    return score


def search(index: Index, queries: DataFrame, k: int, same_label: bool, first: int = FIRST, growth: int = GROWTH) -> DataFrame:
    """The best k rows in every window of every query: row, w, score, id, found, rank (higher scores first, then smaller ids).

    ``queries``: row, label, v, low and high (arrays of the windows' ends). Rows of the query's label, or of all others;
    never the query's own row. Exact: a query is done when no cell left can hold a row that counts.
    """
    spark, best = queries.sparkSession, None
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("found")]
    spread = queries.repartitionByRange(shuffle_partitions(spark), "row").select("row", "label", "v", "low", "high")
    blocks = index.blocks.repartition(index.buckets, "bucket").groupBy("bucket")
    rounds = [(0, first), (first, first * growth), (first * growth, float("inf"))]
    for skip, budget in rounds:
        lowest = F.transform("low", lambda x: F.lit(-_OPEN))
        if best is None:
            asked = spread.withColumn("best", lowest)
        else:
            kth = best.where(F.col("rank") == k).groupBy(F.col("row").alias("r")).agg(
                F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("kth"))
            asked = spread.join(kth, F.col("row") == F.col("r"), "left").withColumn("best", F.when(F.col("kth").isNull(), lowest).otherwise(
                F.transform("low", lambda x, i: F.coalesce(F.element_at("kth", i), F.lit(-_OPEN))))).drop("r", "kth")
        requests = asked.mapInArrow(returned(_requests(index, skip, budget)), from_arrow_schema(_REQUESTS))
        found = requests.repartition(index.buckets, "bucket").groupBy("bucket").cogroup(blocks).applyInArrow(
            _score(index.dims, k, same_label, *index.ranges()), from_arrow_schema(_FOUND))
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = materialise(found.withColumn("rank", F.row_number().over(Window.partitionBy("row", "w").orderBy(*order))).where(F.col("rank") <= k))
    return best


def mine(rows: DataFrame, index: Index, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES,
         low: int = LOW, high: int = HIGH, **how) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` are rows of ``rows``. Each one's positives are its best rows of the same label; for each positive the best
    rows of other labels whose score is ``low`` to ``high`` percent of the positive's.
    """
    queries = anchors.select("row", "id", "label", "v")
    everything = queries.withColumns({"low": F.array(F.lit(-_OPEN + 1)), "high": F.array(F.lit(_OPEN))})
    near = search(index, everything, positives, True, **how).select("row", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"),
                                                                F.col("score").alias("positive_score"))
    # Ends in whole numbers: low * p / 100 rounded up, high * p / 100 rounded down; none for a negative score.
    p = F.col("positive_score")
    start = F.when(p < 0, F.lit(1)).otherwise(F.expr(f"(positive_score * {low} + 99) div 100"))
    stop = F.when(p < 0, F.lit(0)).otherwise(F.expr(f"(positive_score * {high}) div 100"))
    windows = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("w", start.cast("long").alias("low"), stop.cast("long").alias("high")))).alias("x"))
    asked = queries.join(windows, "row").select("row", "label", "v", F.col("x.low").alias("low"), F.col("x.high").alias("high"))
    hard = search(index, asked, negatives, False, **how)
    return (hard.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(near, ["row", "w"])
            .join(queries.select("row", F.col("id").alias("anchor_id")), "row")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    # Every seventh row's label is wrong, so that close rows of other labels exist.
    table = table.withColumn("label", F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label")))
    rows = materialise(vectors(table))
    index = build(rows)
    if index is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return mine(rows, index, rows.where(F.col("id") % 50 == 0))


OP13_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, row_number() OVER () AS n,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.n AS a, a.vec_id AS anchor_id, b.n AS b, b.vec_id, a.label = b.label AS same,
    CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.n <> b.n),
p AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id) AS r FROM s WHERE same) x
  WHERE r <= {POSITIVES}),
g AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.a = s.a AND NOT s.same AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM g
WHERE rank <= {NEGATIVES}"""
