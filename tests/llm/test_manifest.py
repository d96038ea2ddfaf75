"""The Merkle manifest against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from dealscreen.llm import merkle

A_Z = {i: i + 32 for i in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, at long, g string, id string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    values = [row[0], row[3], row[2], row[4], row[1]]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i:i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def climb(tree, i, node):
    """Siblings of leaf i and the root folded from node."""
    proof = ""
    for nodes in tree[:-1]:
        s = i // 8 * 8
        before, behind = "".join(nodes[s:i]), "".join(nodes[i + 1:s + 8])
        proof, node, i = proof + before + behind, h(before + node + behind), i // 8
    return proof, node


def expected(rows):
    groups = {}
    for r in rows:
        groups.setdefault("0" if r[2] is None else "1" + r[2], []).append(r)
    trees = {}
    for g, members in groups.items():
        members.sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        trees[g] = levels([leaf(r) for r in members])
    order = sorted(groups, key=lambda g: g.encode())
    top = levels([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for i, r in enumerate(groups[g]):
            now = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                now = (r[0], r[1].translate(A_Z), *r[2:])
            p1, node = climb(trees[g], i, leaf(now))
            p2, node = climb(top, k, node)
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], h(p1 + p2), node, node == top[-1][0]))
    return out


def got(spark, rows, tmp):
    path = f"{tmp}/{random.random()}"
    spark.createDataFrame([(*r, "x", 1, "g", "i") for r in rows], SCHEMA).repartition(4).write.parquet(f"{path}/documents.parquet")
    out = merkle.op11_manifest(spark, path)
    return [tuple(r)[:7] for r in out.collect()]


def key(rows):
    return sorted(rows, key=str)


def test_manifest(spark, texts, tmp_path):
    """Null ids, texts and groups, repeated ids with equal and other contents, groups of one, 8, 9 and 75 rows, far apart and
    negative ids."""
    rng = random.Random(3)
    rows = [(i, (t or "").title() if t is not None else None, ["en", "fr", None][(i or 0) % 3], "s", len(t or "")) for i, t in texts]
    rows += [(rng.randrange(-2**62, 2**62), f"Text {i}", "far", None, None) for i in range(75)]
    rows += [(i, "A B", "eight", "s", 3) for i in range(8)] + [(7 * i, "É ü", "nine", "s", 3) for i in range(9)]
    rows += [(5, "only", "", "s", 4), (-2**63, "a", "far", "s", 1), (2**63 - 1, "B", "far", "s", 1)]
    rows += [(64, f"T{i % 7}", "same", "s", 2) for i in range(40)] + [(i, "U", "same", "s", 2) for i in range(60, 70)]
    assert key(got(spark, rows, tmp_path)) == key(expected(rows))


def test_manifest_more_than_one_slot_array(spark):
    """Arrays of 8 slots: several rounds of arrays in a group, and of groups."""
    rows = [(i * 37 % 1000, f"T{i}", f"l{i % 11}" if i % 4 else "big", None, i) for i in range(900)]
    out = merkle.manifest(merkle.leaves(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")), levels=1)
    want = [(r[0], *r[1:5]) for r in expected(rows)]
    assert key([(r.id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in out.collect()]) == key(want)
    assert all(r.folded_root == r.root for r in out.collect())


def test_manifest_empty(spark, tmp_path):
    assert got(spark, [], tmp_path) == []


def test_coordinates_by_rank_queries(spark):
    """Places without sorting: ids over the whole range of 64 bits, directories of few children."""
    rng = random.Random(5)
    ids = [rng.randrange(-2**63, 2**63) for _ in range(300)] + list(range(-200, 200)) + [2**40 + i * 4096 for i in range(100)]
    rows = spark.createDataFrame([("1a", i) for i in ids], "g string, id long").select(
        "g", "id", F.monotonically_increasing_id().alias("row"), F.lit(b"x").alias("leaf"), F.lit(b"y").alias("now"))
    placed, sizes = merkle.coordinates(merkle.materialise(rows))
    assert [r.id for r in sorted(placed.collect(), key=lambda r: r.at)] == sorted(ids)
    assert sizes.first().n == len(ids)


@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 64, 65])
def test_fold_and_climb(n):
    nodes = [h(str(i)) for i in range(n)]
    tree = merkle.fold(nodes, merkle._height(n))
    assert [t for t in tree] == levels(nodes) if n else tree == [[]]
    steps = merkle.siblings(tree)
    for i in range(n):
        assert merkle.climb(nodes[i], [level[i // 8 ** k] for k, level in enumerate(steps)]) == tree[-1][0]
