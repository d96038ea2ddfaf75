"""XXH64 of many byte slices at once (the public algorithm, vectorised over slices of equal length)."""

from __future__ import annotations

import numpy as np
import xxhash

# Fixed values of the XXH64 specification.
P1 = np.uint64(11400714785074694791)
P2 = np.uint64(14029467366897019727)
P3 = np.uint64(1609587929392839161)
P4 = np.uint64(9650029242287828579)
P5 = np.uint64(2870177450012600261)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def _round(acc, lane):
    return _rotl(acc + lane * P2, 31) * P1


def _equal_length(w8, w4, data, starts: np.ndarray, n: int, seed: int) -> np.ndarray:
    s, at = np.uint64(seed), 0
    if n >= 32:
        acc = [np.full(len(starts), v, np.uint64) for v in (s + P1 + P2, s + P2, s, s - P1)]
        while at + 32 <= n:
            acc = [_round(a, w8[starts + (at + 8 * i)]) for i, a in enumerate(acc)]
            at += 32
        h = _rotl(acc[0], 1) + _rotl(acc[1], 7) + _rotl(acc[2], 12) + _rotl(acc[3], 18)
        for a in acc:
            h = (h ^ _round(np.uint64(0), a)) * P1 + P4
    else:
        h = np.full(len(starts), s + P5, np.uint64)
    h = h + np.uint64(n)
    while at + 8 <= n:
        h = _rotl(h ^ _round(np.uint64(0), w8[starts + at]), 27) * P1 + P4
        at += 8
    if at + 4 <= n:
        h = _rotl(h ^ (w4[starts + at].astype(np.uint64) * P1), 23) * P2 + P3
        at += 4
    while at < n:
        h = _rotl(h ^ (data[starts + at].astype(np.uint64) * P5), 11) * P1
        at += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def xxh64_slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 42) -> np.ndarray:
    """XXH64 of data[starts[i]:ends[i]] for every i."""
    out = np.empty(len(starts), np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    w8 = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    w4 = np.ndarray((len(data) + 5,), "<u4", padded.data, strides=(1,))
    length = (ends - starts).astype(np.int64)
    order = np.argsort(length.astype(np.uint16) if length.max(initial=0) < 65536 else length, kind="stable")
    cuts = np.flatnonzero(np.diff(length[order])) + 1
    with np.errstate(over="ignore"):
        for group in np.split(order, cuts) if len(order) else []:
            n = int(length[group[0]])
            if len(group) < 8:
                out[group] = [xxhash.xxh64_intdigest(data[a:a + n].tobytes(), seed) for a in starts[group].tolist()]
            else:
                out[group] = _equal_length(w8, w4, padded, starts[group], n, seed)
    return out
