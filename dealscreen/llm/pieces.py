"""Sampled segmentations of texts into SentencePiece ids: Gumbel top-k without replacement over the piece lattice.

A text (identity normalisation, a space in front, spaces as U+2581) is cut before every run of spaces, which no piece
crosses; the lattice of each distinct part has an edge for every vocabulary piece that matches, and one for a character
without a piece (its byte pieces). Pieces have Zipf probabilities by their rank in the model, so a segmentation's
probability is the product of its pieces', divided by the lattice's total (backward log sums).

Search per text: the root's perturbed log probability is a Gumbel draw; going down, the sampled way through
a part inherits the bound and the set of all other ways gets a Gumbel truncated at it (a set that is expanded falls into
those that leave the way at one of its edges). Best-first (A*) over these bounds: the largest
open set is expanded next, its sampled completion is the next segmentation. So the k segmentations emitted are the k
largest perturbed ones: distinct, without replacement, in order. Inclusion score: 1 - exp(-exp(log p - kappa)), kappa the
largest bound left. All draws are hashes of the row key, the place in the text and the round: a recomputed task repeats
them.

Defined cases: null and empty texts have no pieces and the one empty segmentation (log p 0, inclusion 1); texts with
fewer than k segmentations give all of them; rows with equal keys draw alike; a literal U+2581 decodes to a space, as in
the model itself.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from dealscreen.llm.common import chunks, mix, read, returned

MODEL, SAMPLES, SEED, CHUNK, SLOT = "/opt/tokenizers/piece_bpe_32k.model", 2, 0, 4 << 20, 20
_MUL, _K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_PARTS = re.compile(" +[^ ]*")


def _uniform(x: np.ndarray) -> np.ndarray:
    """Uniform draws in (0, 1) from 64-bit keys."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


class Pieces:
    """The vocabulary: log probabilities, surface bytes, and all piece prefixes by hash."""

    def __init__(self, model: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.size = sp.get_piece_size()
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{i:02X}>") for i in range(256)], np.int32)
        rank = np.arange(1, self.size + 1, dtype=np.float64)
        self.logp = -np.log(rank) - np.log((1 / rank).sum())
        surface = [b""] * self.size
        for i, piece in enumerate(self.byte_ids.tolist()):
            surface[piece] = bytes([i])
        self.longest = 1
        prefixes: dict[int, int] = {}
        for i in range(self.size):
            if sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i):
                continue
            piece = sp.id_to_piece(i)
            surface[i] = piece.replace("▁", " ").encode()
            self.longest = max(self.longest, len(piece))
            h = 0
            for j, c in enumerate(piece):
                h = (h * int(_MUL) + ord(c) + 1) & (2**64 - 1)
                prefixes[h] = i if j == len(piece) - 1 else prefixes.get(h, -1)
        keys = np.array(list(prefixes), np.uint64) * _K1  # short prefixes' hashes are small numbers: spread them
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(list(prefixes.values()), np.int64)[order]
        # Where the keys with the same first SLOT bits begin: a hash is looked for among those alone.
        self.begin = np.searchsorted(self.keys >> np.uint64(64 - SLOT), np.arange(1 << SLOT, dtype=np.uint64)).astype(np.int32)
        self.deepest = int(np.bincount(self.keys >> np.uint64(64 - SLOT)).max())
        worst = float(self.logp.min())
        # After the pieces: characters without a piece, by their 1 to 4 bytes.
        self.logp = np.concatenate([self.logp, worst * np.arange(1, 5)])
        self.surface = pa.array(surface, pa.binary())

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash starts a piece, and the piece it is (-1: none)."""
        h = h * _K1
        slot = np.minimum(self.begin[h >> np.uint64(64 - SLOT)], len(self.keys) - 1)
        hit = self.keys[slot] == h
        left = np.flatnonzero(~hit)
        for _ in range(self.deepest - 1):
            left = left[self.keys[slot[left]] < h[left]]
            slot[left] = np.minimum(slot[left] + 1, len(self.keys) - 1)
            hit[left] = self.keys[slot[left]] == h[left]
        return hit, np.where(hit, self.ids[slot], -1)


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    return Pieces(model)


class Lattice:
    """All distinct parts at once: by node and piece length the piece, its probability there and the cumulated one.

    ``log_weight`` of an edge is its own log probability, ``total`` of a part the log sum over its segmentations.
    """

    def __init__(self, parts: list[str], vocabulary: Pieces):
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        cp = np.frombuffer("".join(parts).replace(" ", "▁").encode("utf-32-le"), np.uint32).astype(np.uint64)
        unit = np.repeat(np.arange(len(parts)), size)
        left = np.cumsum(size)[unit] - np.arange(len(cp))  # characters from here to the part's end
        self.first = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        nodes = np.arange(len(cp)) + unit
        self.final = np.ones(len(cp) + len(parts), bool)
        self.final[nodes] = False
        self.character = np.zeros(len(self.final), np.int32)
        self.character[nodes] = cp
        self.vocabulary = vocabulary
        found, wide = [], 1
        at, h, n = np.arange(len(cp)), np.zeros(len(cp), np.uint64), 0
        while len(at):
            h = h * _MUL + cp[at + n] + np.uint64(1)
            hit, ids = vocabulary.find(h)
            n += 1
            whole = ids >= 0
            if whole.any():
                found.append((nodes[at[whole]], n - 1, ids[whole]))
                wide = n
            more = hit & (left[at] > n)
            at, h = at[more], h[more]
        self.id = np.full((len(self.final), wide), -1, np.int32)
        for where, column, ids in found:
            self.id[where, column] = ids
        lone = np.flatnonzero(self.id[nodes, 0] < 0)
        c = cp[lone].astype(np.int64)
        width = (c > 0x7F).astype(int) + (c > 0x7FF) + (c > 0xFFFF)
        self.id[nodes[lone], 0] = np.where(width, vocabulary.size + width, vocabulary.byte_ids[np.minimum(c, 127)])
        # Backward sums, all nodes at the same distance from their part's end at once. Weights are scaled by a factor
        # per character, and every ``wide`` characters a part's sums are rescaled, so that none leaves the range.
        scale = np.exp(3.0 * np.arange(1, wide + 1))
        weights = np.append(np.exp(vocabulary.logp), 0.0)  # the last one for -1
        z = self.final.astype(np.float64)
        self.cum = np.zeros((len(self.final), wide))
        order = np.argsort(left.astype(np.uint16) if len(left) and left.max() < 65536 else left, kind="stable")
        cuts = np.searchsorted(left[order], np.arange(1, (left.max() if len(left) else 0) + 2))
        total = np.zeros(len(parts))
        for d, (a, b) in enumerate(zip(cuts, cuts[1:]), 1):
            own = nodes[order[a:b]]
            reach = min(d, wide)
            w = weights[self.id[own, :reach]]
            w *= scale[:reach]
            w *= z[own[:, None] + np.arange(1, reach + 1)]
            w = np.cumsum(w, axis=1)
            z[own] = w[:, -1]
            w /= w[:, -1:]
            self.cum[own, :reach] = w
            self.cum[own, reach:] = 1.0
            if d % wide == 0:
                factor = z[own].copy()
                total[unit[order[a:b]]] += np.log(factor)
                for j in range(wide):
                    z[own + j] /= factor
        self.total = np.log(z[self.first]) + total - 3.0 * size

    def weights(self, node: int) -> np.ndarray:
        return np.diff(self.cum[node], prepend=0.0)

    def descend(self, nodes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sample a path to the end from every node: nodes and edges of all paths, one after the other, and their numbers."""
        steps = np.zeros(len(nodes), np.int64)
        active, taken, n = np.flatnonzero(~self.final[nodes]), [], 0
        cur, key = nodes[active], keys[active]
        while len(active):
            u = _uniform(key + _times(n, _K2))
            e = (np.take(self.cum, cur, axis=0) >= u[:, None]).argmax(axis=1)
            taken.append((active, cur, e))
            steps[active] += 1
            cur = cur + e + 1
            go = ~self.final[cur]
            active, cur, key = active[go], cur[go], key[go]
            n += 1
        offset = np.cumsum(steps) - steps
        at, edges = np.empty(int(steps.sum()), np.int64), np.empty(int(steps.sum()), np.int8)
        for i, (who, cur, e) in enumerate(taken):
            at[offset[who] + i], edges[offset[who] + i] = cur, e
        return at, edges, steps


def _times(n: int, factor: np.uint64) -> np.uint64:
    return np.uint64(n * int(factor) & (2**64 - 1))


def _plus(*parts) -> np.ndarray:
    return np.array([sum(int(p) for p in parts) & (2**64 - 1)], np.uint64)


def _truncated(location: np.ndarray, bound, key: np.ndarray) -> np.ndarray:
    """Gumbel draws with these locations that don't exceed the bound."""
    exponential = -np.log(_uniform(key))
    return location - np.log(exponential + np.exp(np.minimum(location - bound, 700.0)))


class _Path:
    """A segmentation: nodes and edges, where each part's end, and the log probability before each part."""

    __slots__ = ("at", "edges", "ends", "before")

    def __init__(self, at, edges, ends, before):
        self.at, self.edges, self.ends, self.before = at, edges, ends, before


def _inner(lattice: Lattice, at: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability before each step of a part, and of the other edges there."""
    cum = lattice.cum[at]
    hi = cum[np.arange(len(at)), edges]
    lo = np.where(edges > 0, cum[np.arange(len(at)), np.maximum(edges, 1) - 1], 0.0)
    other = lo + (1.0 - hi)
    return np.concatenate([[1.0], np.cumprod(hi - lo)]), other


def sample(texts: pa.Array, seeds: np.ndarray, k: int, vocabulary: Pieces) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to k (ids, log p, inclusion score), the largest perturbed log probability first."""
    texts = pc.fill_null(texts, "").cast(pa.string())
    filled = pc.binary_join_element_wise("", texts, " ")  # the space in front
    if pc.any(pc.match_substring(filled, "  ")).as_py():
        listed = pa.array([_PARTS.findall(t) if t != " " else [] for t in filled.to_pylist()], pa.list_(pa.string()))
        flat, offsets = listed.values, listed.offsets.to_numpy().astype(np.int64)
    else:
        lists = pc.split_pattern(texts, " ")
        flat = pc.binary_join_element_wise("", lists.flatten(), " ")
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        n = np.where(empty, 0, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        if empty.any():
            own = np.repeat(~empty, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            flat = flat.filter(pa.array(own))
        offsets = np.concatenate([[0], np.cumsum(n)])
    encoded = flat.dictionary_encode()
    codes = encoded.indices.to_numpy().astype(np.int64)
    rows = len(offsets) - 1
    if not len(codes):
        return [[(np.empty(0, np.int32), 0.0, 1.0)] for _ in range(rows)]
    lattice = Lattice(encoded.dictionary.to_pylist(), vocabulary)
    heads, totals = lattice.first[codes], lattice.total[codes]
    root = mix(seeds.astype(np.uint64) + _K1)
    bounds = -np.log(-np.log(_uniform(root)))
    found: list[list[_Path]] = [[] for _ in range(rows)]
    # Open sets of each text: (bound, path, part, step, edges taken there); step None: all other ways through the part.
    waiting: list[list] = [[] for _ in range(rows)]
    jobs = [(r, None, 0, None, (), float(bounds[r])) for r in range(rows) if offsets[r + 1] > offsets[r]]
    ramp = np.arange(int(np.diff(offsets).max()), dtype=np.uint64) * _MUL
    for turn in range(k):
        nodes, keys, sums, spans = [], [], [], []
        starts = mix(root + _times(turn, _K1))
        draws = _uniform((root + _times(turn, _K2))[:, None] + np.arange(2, dtype=np.uint64)) if turn else None
        for r, path, part, step, taken, bound in jobs:
            lo, hi = int(offsets[r]), int(offsets[r + 1])
            keys.append(starts[r] + ramp[part:hi - lo])
            if path is None:
                spans.append((r, lo, None, bound))
                nodes.append(heads[lo:hi])
                sums.append(totals[lo:hi])
                continue
            start = int(path.ends[part - 1]) if part else 0
            at, edges = path.at[start:path.ends[part]], path.edges[start:path.ends[part]]
            before, other = _inner(lattice, at, edges)
            u = draws[r]
            if step is None:
                # The set falls into those that leave the part's way at one of its steps.
                mass = before[:-1] * other
                cum = np.cumsum(mass)
                step = min(int((cum < u[0] * cum[-1]).sum()), len(cum) - 1)
                taken = (int(edges[step]),)
                rest = np.flatnonzero((mass > 0) & (np.arange(len(mass)) != step))
                g = _truncated(path.before[part] + np.log(mass[rest]), bound,
                               _plus(root[r], _times(turn, _MUL), int(_K2)) + rest.astype(np.uint64) * _K1)
                waiting[r] += [(float(b), path, part, int(i), (int(edges[i]),)) for b, i in zip(g, rest)]
            weight = lattice.weights(int(at[step]))
            weight[list(taken)] = 0
            cum = np.cumsum(weight)
            edge = min(int((cum < u[1] * cum[-1]).sum()), len(cum) - 1)
            if np.count_nonzero(weight) > 1:
                g = _truncated(path.before[part] + np.log(before[step:step + 1] * (cum[-1] - weight[edge])), bound,
                               _plus(root[r], _times(turn + 1, _K1), _times(step, _MUL)) ^ _K2)
                waiting[r].append((float(g[0]), path, part, step, (*taken, edge)))
            spans.append((r, lo + part, (path, start, at[:step + 1], np.append(edges[:step], edge)), bound))
            nodes.append(np.concatenate([[at[step] + edge + 1], heads[lo + part + 1:hi]]))
            sums.append(totals[lo + part:hi])
        if not spans:
            break
        all_at, all_edges, steps = lattice.descend(np.concatenate(nodes), np.concatenate(keys))
        piece_log = np.append(vocabulary.logp[lattice.id[all_at, all_edges]], 0.0)
        step_ends = np.cumsum(steps)
        log = np.add.reduceat(piece_log, step_ends - steps)
        log[steps == 0] = 0.0
        log -= np.concatenate(sums)
        per_job = np.array([len(n) for n in nodes])
        ends = np.cumsum(per_job)
        jobs, made = [], []
        for (r, first, opened, bound), a, z in zip(spans, ends - per_job, ends):
            base = int(step_ends[a - 1]) if a else 0
            at, edges, own_ends = all_at[base:step_ends[z - 1]], all_edges[base:step_ends[z - 1]], step_ends[a:z] - base
            own = log[a:z]
            part = int(first - offsets[r])
            if opened is None:
                path = _Path(at, edges, own_ends, np.concatenate([[0.0], np.cumsum(own)]))
            else:
                old, start, at0, edges0 = opened
                own[0] += vocabulary.logp[lattice.id[at0, edges0]].sum()
                path = _Path(np.concatenate([old.at[:start], at0, at]), np.concatenate([old.edges[:start], edges0, edges]),
                             np.concatenate([old.ends[:part], own_ends + start + len(at0)]),
                             np.concatenate([old.before[:part], old.before[part] + np.concatenate([[0.0], np.cumsum(own)])]))
            found[r].append(path)
            made.append((path, part))
        # The other ways through each part, of all texts at once.
        other = -np.expm1(np.minimum(log, 0.0))
        # In a part just changed only what lies beyond the new edge is open.
        other[(ends - per_job)[[opened is not None for _, _, opened, _ in spans]]] = 0.0
        other[other < 1e-13] = 0.0
        key = (np.repeat(root[[r for r, _, _, _ in spans]] ^ _K2, per_job)
               + (np.concatenate([ramp[part:part + n] for (_, part), n in zip(made, per_job)]) + _times(turn, _K1)))
        with np.errstate(divide="ignore"):
            bounds = _truncated(np.concatenate([path.before[part:-1] for path, part in made]) + np.log(other),
                                np.repeat([bound for _, _, _, bound in spans], per_job), key)
        for (r, _, opened, bound), (path, part), a, z in zip(spans, made, ends - per_job, ends):
            if opened is not None:
                s0, s1 = opened[1] + len(opened[2]), int(path.ends[part])
                before, beside = _inner(lattice, path.at[opened[1]:s1], path.edges[opened[1]:s1])
                mass = (before[:-1] * beside)[s0 - opened[1]:]
                rest = np.flatnonzero(mass > 0)
                g = _truncated(path.before[part] + np.log(mass[rest]), bound, mix(key[a:a + 1]) + (rest + 1).astype(np.uint64) * _K1)
                waiting[r] += [(b, path, part, s0 - opened[1] + i, (int(path.edges[s0 + i]),)) for b, i in zip(g.tolist(), rest.tolist())]
            # Only the largest bounds can still be needed.
            g, need = bounds[a:z], k + 1 - len(found[r])
            best = np.argpartition(-g, need)[:need + 1].tolist() if len(g) > need + 1 else range(len(g))
            waiting[r] += [(float(g[i]), path, part + i, None, ()) for i in best if g[i] > -np.inf]
            waiting[r].sort(key=lambda x: -x[0])
            if waiting[r] and turn + 1 < k:
                g, path, part, step, taken = waiting[r].pop(0)
                jobs.append((r, path, part, step, taken, g))
    paths = [path for of in found for path in of]
    ids = iter(_ids(lattice, paths))
    out = []
    for r in range(rows):
        kappa = waiting[r][0][0] if waiting[r] else -np.inf
        made = [(next(ids), float(path.before[-1]),
                 float(-np.expm1(-np.exp(min(path.before[-1] - kappa, 700.0))))) for path in found[r]]
        out.append(made or [(np.empty(0, np.int32), 0.0, 1.0)])
    return out


def _ids(lattice: Lattice, paths: list[_Path]) -> list[np.ndarray]:
    """Piece ids of the paths; a character without a piece becomes its bytes' pieces."""
    if not paths:
        return []
    cuts, voc = np.cumsum([len(path.at) for path in paths])[:-1], lattice.vocabulary
    out = np.split(lattice.id[np.concatenate([path.at for path in paths]), np.concatenate([path.edges for path in paths])], cuts)
    for n, (path, ids) in enumerate(zip(paths, out)):
        if not len(ids) or ids.max() < voc.size:
            continue
        parts, last = [], 0
        for i in np.flatnonzero(ids >= voc.size).tolist():
            parts += [ids[last:i], voc.byte_ids[list(chr(lattice.character[path.at[i]]).encode())]]
            last = i + 1
        out[n] = np.concatenate([*parts, ids[last:]])
    return out


def decode(ids, vocabulary: Pieces) -> str:
    """The text of the pieces, without the space in front."""
    return decoded([np.asarray(ids, np.int32)], vocabulary)[0]


def decoded(lists: list[np.ndarray], vocabulary: Pieces) -> list[str]:
    """The texts of several lists of pieces."""
    joined = vocabulary.surface.take(pa.array(np.concatenate([np.empty(0, np.int32), *lists]).astype(np.int32)))
    if not len(joined):
        return [""] * len(lists)
    offsets = np.frombuffer(joined.buffers()[1], np.int32)[joined.offset:joined.offset + len(joined) + 1]
    ends = offsets[np.cumsum([0, *map(len, lists)])].tolist()
    data = joined.buffers()[2]
    data = data.to_pybytes() if data else b""
    texts = [data[a:z].decode("utf-8", "replace") for a, z in zip(ends, ends[1:])]
    return [t[1:] if t.startswith(" ") else t for t in texts]


_SAMPLES = "array<struct<ids:array<int>,log_prob:double,inclusion:double>>"


def row_seeds(keys: pa.Array, seed: int) -> np.ndarray:
    text = [f"{seed}|{'' if k is None else k}".encode() for k in keys.to_pylist()]
    return np.array([int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "little") for t in text], np.uint64)


def sampled(docs: DataFrame, k: int = SAMPLES, seed: int = SEED, model: str = MODEL, key: str = "doc_id",
            digest: bool = False) -> DataFrame:
    """row (the document, all columns) and its samples; with digest their sizes, hashes and round trips instead of ids."""
    # The text travels to Python once, beside the other columns; whole samples come in smaller batches than digests.
    kept = [key] if digest else docs.columns
    others = [c for c in kept if c != "text"]
    rows = docs.select(F.struct(*others, F.lit(None).cast("byte").alias("_")).alias("row"), F.col(key).alias("key"),
                       F.col("text").cast("string").alias("text"))
    kind = _SAMPLES if not digest else ("array<struct<n_pieces:bigint,ids_sha256:string,round_trip:boolean,"
                                        "log_prob:double,inclusion:double>>")

    def run(batches):
        vocabulary = pieces(model)
        for b in chunks(batches, limit=CHUNK if digest else CHUNK // 8):
            texts = b.column("text").to_pylist()
            made = sample(b.column("text"), row_seeds(b.column("key"), seed), k, vocabulary)
            if digest:
                back = iter(decoded([i for s in made for i, _, _ in s], vocabulary))
                lists = [[{"n_pieces": len(i), "ids_sha256": hashlib.sha256(i.astype("<i4").tobytes()).hexdigest(),
                           "round_trip": next(back) == (t or ""), "log_prob": p, "inclusion": q}
                          for i, p, q in s] for s, t in zip(made, texts)]
                type_ = pa.list_(pa.struct([("n_pieces", pa.int64()), ("ids_sha256", pa.string()),
                                            ("round_trip", pa.bool_()), ("log_prob", pa.float64()), ("inclusion", pa.float64())]))
                out = pa.array(lists, type_)
            else:
                every = [x for s in made for x in s]
                ids = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in every])]), pa.int32()),
                    pa.array(np.concatenate([x[0] for x in every]), pa.int32()))
                struct = pa.StructArray.from_arrays([ids, pa.array([x[1] for x in every], pa.float64()),
                                                     pa.array([x[2] for x in every], pa.float64())],
                                                    names=["ids", "log_prob", "inclusion"])
                out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(s) for s in made])]), pa.int32()), struct)
            columns = {"row": b.column("row"), "samples": out, **({} if digest else {"text": b.column("text")})}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    schema = f"row {rows.schema['row'].dataType.simpleString()}, samples {kind}{'' if digest else ', text string'}"
    row = F.struct(*[F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in kept]).alias("row")
    return rows.mapInArrow(returned(run), schema).select(row, "samples")


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return sampled(docs, digest=True).select(F.col("row.doc_id").alias("doc_id"), F.posexplode("samples").alias("pos", "s")).select(
        "doc_id", (F.col("pos") + 1).cast("long").alias("sample"), "s.*")


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with their sampled segmentations (ids, log p, inclusion score)."""
    return sampled(docs).select("row.*", F.col("samples").alias("piece_samples"))
