"""Substring, suffix and SimHash dedup against brute force."""

import hashlib
import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from dealscreen.llm import simhash, substrings, suffixes


def rows(df):
    return [tuple(r) for r in df.collect()]


def removed_words(texts, window=13):
    low, high = {}, {}
    key = lambda i: 2**63 - 1 if i is None else i
    split = [(i, (t or "").encode().split()) for i, t in texts]
    for i, w in split:
        for s in range(len(w) - window + 1):
            x = tuple(w[s:s + window])
            low[x], high[x] = min(key(i), low.get(x, 2**63)), max(key(i), high.get(x, -1))
    out = []
    for i, w in split:
        gone, length, longest = set(), window, 0
        for s in range(len(w) - window + 1):
            x = tuple(w[s:s + window])
            if low[x] < key(i):
                gone.update(range(s, s + window))
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


def test_substrings(docs, texts):
    got = substrings.deduplicated(docs)
    assert Counter(r[:4] for r in rows(got)) == Counter(removed_words(texts))


def test_substring_levels(docs, texts):
    longest = {r.doc_id: r.longest_window for r in substrings.deduplicated(docs).collect()}
    n = len(texts[0][1].split())
    want = 0
    while 13 * 2 ** want <= n:
        want += 1
    assert longest[100] == (13 * 2 ** (want - 1) if want else 0)
    assert longest[104] == 52 and longest[106] == 0


def longest_windows(texts, window):
    """By row: the longest of window, twice it and so on at which one of its windows starts in another document too."""
    out, n = [0] * len(texts), window
    while True:
        owners, of = defaultdict(set), defaultdict(set)
        for r, (i, t) in enumerate(texts):
            w = (t or "").split()
            for s in range(len(w) - n + 1):
                owners[tuple(w[s:s + n])].add(i)
                of[tuple(w[s:s + n])].add(r)
        found = {r for x, ids in owners.items() if len(ids) > 1 for r in of[x]}
        if not found:
            return out
        for r in found:
            out[r] = n
        n *= 2


@pytest.mark.parametrize("window", [1, 2, 5, 8])
def test_substring_windows(spark, window):
    """Other lengths, many chunks: the base level is reached through shorter windows, overlapping where it isn't their double."""
    rng = random.Random(window)
    made = [(rng.randrange(40), " ".join(rng.choice("abcdefghij") * rng.randrange(1, 3) for _ in range(rng.randrange(30))))
            for _ in range(60)]
    made += [(90, "k l m n o p"), (90, "q r s t u v"), (91, "k l m n o p q r s t u v"), (None, "k l m n o p"), (92, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string").repartition(7)
    got = substrings.deduplicated(docs, window).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(removed_words(made, window))
    assert Counter((r.doc_id, r.n_words, r.longest_window) for r in got) == Counter(
        (i, len((t or "").split()), n) for (i, t), n in zip(made, longest_windows(made, window)))


def test_substring_window_stays_in_its_row(spark):
    """Rows of equal id that lie side by side are not read across."""
    made = [(1, "a b c d"), (1, "e f g h"), (2, "a b c d e f g h"), (3, "d e f")]
    got = substrings.deduplicated(spark.createDataFrame(made, "doc_id long, text string").coalesce(1), 4).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(removed_words(made, 4))
    assert all(r.longest_window <= 4 for r in got)


def test_substring_hot_window(spark):
    """A passage in a third of the documents, several times in each, is sent once a chunk; a length's tables are deleted."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(20))
    made = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) + (f" {passage} x{i} {passage}" if i % 3 == 0 else ""))
            for i in range(300)]
    chunks = substrings.packed_chunks(spark.createDataFrame(made, "doc_id long, text string").repartition(4))
    states = []
    for row in chunks.select("chunk", "ids", "texts").mapInArrow(
            substrings._words_level(True, 4), substrings._STATE).collect():
        states.append(sum(len(substrings.unpack(s["h"], "uint64")) for s in row.sent))
    assert sum(states) <= 300 * 20 + 100 + len(states) * 20
    got = substrings.deduplicated(spark.createDataFrame(made, "doc_id long, text string").repartition(4)).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(removed_words(made))


def test_substring_tables_of_shorter_windows_are_deleted(docs, monkeypatch):
    written, deleted = [], []
    plain, buckets, drop = substrings.materialise, substrings.materialise_buckets, substrings.discard
    monkeypatch.setattr(substrings, "materialise", lambda df, path: written.append(path) or plain(df, path))
    monkeypatch.setattr(substrings, "materialise_buckets",
                        lambda df, key, n, path: written.append(path) or buckets(df, key, n, path))
    monkeypatch.setattr(substrings, "discard", lambda spark, path: deleted.append(path) or drop(spark, path))
    chunks = substrings.packed_chunks(docs)
    last = substrings.levels(chunks)
    assert last.count() == chunks.count()
    assert set(deleted) == set(written[:-1]) and written[-1] not in deleted
    assert not [t.name for t in docs.sparkSession.catalog.listTables() if t.name.startswith("llm_")]


def test_substring_short_windows_are_not_stored(spark, monkeypatch):
    """Common words in ever new order: tables of places hold none of them, only windows whose both halves are repeated."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(200)]
    passage = " ".join(rng.choice(vocabulary) for _ in range(14))
    made = [(i, " ".join(rng.choice(vocabulary) for _ in range(120))) for i in range(60)] + [(100, passage), (101, f"x {passage}")]
    docs, places = spark.createDataFrame(made, "doc_id long, text string").repartition(5), []
    plain = substrings.materialise_buckets

    def stored(df, key, n, path, **options):
        table = plain(df, key, n, path, **options)
        if "code" in table.columns:
            places.append(sum(len(substrings.unpack(r.code, "uint32")) for r in table.collect()))
        return table

    monkeypatch.setattr(substrings, "materialise_buckets", stored)
    got = substrings.deduplicated(docs).collect()
    assert Counter(tuple(r)[:4] for r in got) == Counter(removed_words(made))
    assert places == [4, 0]  # the passage's two windows of 13 words in both documents


def removed_bytes(texts, length=200):
    count = Counter()
    for _, t in texts:
        b = (t or "").encode()
        count.update(b[i:i + length] for i in range(len(b) - length + 1))
    out = []
    for d, t in texts:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i in range(len(b)) if gone[i] and (not i or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffixes.HOT, 1])
def test_suffixes(docs, texts, hot):
    assert Counter(rows(suffixes.deduplicated(docs, hot))) == Counter(removed_bytes(texts))


def test_anchors_of_a_chunk_take_little_memory():
    """A chunk's texts are taken a part at a time; whole, they took seventy times their bytes in a worker."""
    rng = np.random.default_rng(5)
    data = rng.integers(97, 101, 3 << 20).astype(np.uint8)
    offsets = np.concatenate([[0, 0, 150], np.arange(3000, len(data), 3000), [len(data)]])
    tracemalloc.start()
    got = suffixes.anchors(data, offsets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * len(data)
    small = offsets[:300]
    want = [suffixes._anchors(data[a:z], np.array([0, z - a])) for a, z in zip(small, small[1:])]
    for i, x in enumerate(suffixes.anchors(data[:small[-1]], small)):
        parts = np.concatenate([w[i] + a if i < 3 else w[i] for w, a in zip(want, small)])
        assert (x == parts).all() and (got[i][:len(x)] == x).all()


def test_merge_never_compares_known_prefixes(monkeypatch):
    runs = [sorted(bytes([97 + (i * j) % 3, 97 + (i + j) % 2, 98]) * 3 for i in range(20)) for j in range(1, 6)]
    calls = []
    plain = suffixes.common_prefix
    monkeypatch.setattr(suffixes, "common_prefix", lambda a, b, known=0: calls.append(known) or plain(a, b, known))
    coded = [suffixes.front_code(r) for r in runs]
    calls.clear()
    merged = list(suffixes.merge_runs(coded))
    assert [s for _, _, s, _ in merged] == sorted(x for r in runs for x in r)
    for (_, _, a, _), (_, _, b, known) in zip(merged, merged[1:]):
        assert known == plain(a, b)
    assert any(calls) and all(suffixes.front_decode(*c) == r for c, r in zip(coded, runs))


def simhash_of(text, k=3):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def components(points, distance):
    names = sorted(set(points.values()) | set())
    parent = {f: f for f in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                parent[find(a)] = find(b)
    return {f: find(f) for f in names}


def simhash_rows(texts, distance=2):
    points = {i: simhash_of(t) for i, (_, t) in enumerate(texts)}
    root = components(points, distance)
    low = defaultdict(list)
    for i, (d, _) in enumerate(texts):
        if d is not None:
            low[root[points[i]]].append(d)
    return [(d, points[i], min(low[root[points[i]]], default=None)) for i, (d, _) in enumerate(texts)]


@pytest.mark.parametrize("distance, bucket", [(2, 64), (3, 64), (2, 1), (3, 1), (1, 2)])
def test_simhash(docs, texts, distance, bucket):
    got = simhash.near_duplicates(docs, distance=distance, bucket=bucket)
    assert Counter((r.row.doc_id, r.fingerprint % 2**64, r.component_id) for r in got.collect()) == Counter(
        simhash_rows(texts, distance))


def test_simhash_hot_buckets_lose_no_link(spark):
    """Many distinct fingerprints in one bucket, linked in chains through both halves."""
    base = 0x0123456789ABCDEF
    points = {base}
    for i in range(0, 40):
        points.add(base ^ (1 << i))
        points.add(base ^ (1 << i) ^ (1 << (i + 3)) ^ (1 << ((i * 7) % 64)))
    points |= {base ^ (0b11111 << 50), base ^ (0b111 << 50)}
    signed = [p - 2**64 if p >> 63 else p for p in points]
    for bucket in (2, 64):
        pairs = simhash.near_pairs(spark.createDataFrame([(p,) for p in signed], "fp long"), bucket=bucket)
        got = {r.node % 2**64: r.root % 2**64 for r in simhash.components(pairs).collect()}
        want = components(dict(enumerate(points)), 2)
        groups = defaultdict(set)
        for p in points:
            groups[want[p]].add(p)
        for group in groups.values():
            assert len({got.get(p, p) for p in group}) == 1


def test_simhash_balls_are_never_broadcast(spark, monkeypatch):
    """Spark takes 66 probes of a fingerprint for one row: their join must not be left to sizes."""
    plans, write = [], simhash.materialise
    fps = write(spark.createDataFrame([((i * 0x9E3779B97F4A7C15) % 2**63,) for i in range(50)], "fp long"))
    monkeypatch.setattr(simhash, "materialise", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or write(df))
    assert simhash.near_pairs(fps).count() == 0
    assert "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]


def test_keep_one(spark, docs, texts):
    kept = simhash.keep_one(spark, docs, "")
    assert kept.columns == docs.columns
    got = kept.collect()
    want = {(c,) for _, _, c in simhash_rows(texts)}
    assert sorted((r.doc_id for r in got), key=str) == sorted((c for c, in want), key=str)


def test_keep_one_broadcasts_no_balls(docs, monkeypatch):
    """Nor in the pipeline's stage: whatever is exploded is joined by merging."""
    plans, write = [], simhash.materialise
    monkeypatch.setattr(simhash, "materialise", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or write(df))
    simhash.keep_one(docs.sparkSession, docs, "")
    probes = [p for p in plans if "Generate inline" in p and "Join" in p]
    assert probes and not any("BroadcastHashJoin" in p for p in probes)


def test_keep_one_moves_texts_once(spark, docs):
    """Which rows stay is told by numbers, ids and hashes; whole rows meet those numbers in one join."""
    plan = simhash.keep_one(spark, docs, "")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Join LeftSemi" in plan and "Window" not in plan


def test_keep_one_tells_documents_of_equal_ids_apart(spark):
    """Unlinked texts that share an id are documents of their own; copies without ids are one."""
    a, b, c = ("".join(f"{w}{i} " for i in range(80)) for w in ("red", "green", "blue"))
    rows = spark.createDataFrame([(1, a), (1, b), (2, c), (3, a), (None, b), (None, "x y z"), (None, "x y z")], "doc_id long, text string")
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(spark, rows, "").collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (2, c), (None, "x y z")], key=str)


@pytest.mark.parametrize("run", [substrings.deduplicated, suffixes.deduplicated, simhash.near_duplicates])
def test_empty(run, no_docs):
    assert run(no_docs).count() == 0
