"""Merkle manifest of a dataset: leaf coordinates by ranks in bitmaps, levels reduced in keyed slot arrays.

1. A document's leaf is the SHA-256 of its fields, each with its byte count in front ("-" if null).
2. Every group (lang) has a bitmap of its document ids: partial words of 64 ids are merged by OR, empty words are not
   stored, and the words of 4,096 ids form a container with a popcount directory (ids before each word). The
   directories of the containers form further levels of 2^18 children at most each, so that no window or task ever holds more
   than that, however many ids a group has.
3. A rank query gives a leaf's coordinate: the directories' entries above it and the set bits below its own in its word.
   No document is sorted for that. Rows that share an id, and rows without one, have no bit of their own: only these are
   numbered by a range partitioning (id, leaf), and their surplus is added to the counts of their word.
4. Coordinate // 4096 is the key of a slot array; an array's task writes its slots, folds runs of 8 up to four levels and
   sends one node up. Arrays of these nodes do the same until one node a group is left; the groups' nodes are numbered
   the same way and give the root. Going down again, every array adds its own siblings to the path of the one above.

``manifest`` returns one row per document with the leaf, the path's digest, and the root folded again from a leaf that
was made from the document as it is now (``tampered``), so that a changed document is found without the others.

Defined cases: a null id is larger than every other; equal ids ascend by leaf, equal leaves are interchangeable; a null
group comes before all others; an empty table has no rows; further columns don't matter, as the input's fields are
named. Fields: integers in decimal, other types as Spark casts them to strings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from dealscreen.llm.common import materialise, read
from dealscreen.operators.rank import global_row_number

#: Children of a node, levels folded by one slot array, ids of a container and children of a directory (as powers of 2).
FAN, LEVELS, CONTAINER_BITS, DIRECTORY_BITS = 8, 4, 12, 18
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEPS = pa.list_(pa.struct([("before", pa.string()), ("behind", pa.string())]))


def leaf_hash(fields: Sequence[Column]) -> Column:
    """SHA-256 (lowercase hex) of the fields: byte count, ":" and value of each, "-" for a null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def leaves(docs: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: Sequence[str] = FIELDS,
           tampered: dict[str, Column] | None = None, tampers: Column | None = None) -> DataFrame:
    """g (group key in the order of groups), id, row, leaf, now (32 bytes each) of every document.

    ``now`` is the leaf of the document as it is now: fields replaced by ``tampered`` where ``tampers`` holds.
    """
    changed = [F.when(tampers, tampered[f]).otherwise(F.col(f)) if tampered and f in tampered else F.col(f) for f in fields]
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col(group_col).cast("string")), F.lit("0")).alias("g"),
        F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
        F.unhex(leaf_hash([F.col(f) for f in fields])).alias("leaf"), F.unhex(leaf_hash(changed)).alias("now"))


def _word(id_col: str = "id") -> Column:
    return F.shiftright(F.col(id_col), 6)


def _below(id_col: str = "id") -> Column:
    """The bits of a word below an id's own."""
    return F.expr(f"~shiftleft(-1L, CAST({id_col} & 63 AS INT))")


def bitmap_words(rows: DataFrame) -> DataFrame:
    """g, w, bits, n: every group's words of 64 ids, those of all partitions merged, and the rows they stand for (null w: no id)."""
    bit = F.expr("shiftleft(1L, CAST(id & 63 AS INT))")
    return rows.groupBy("g", _word().alias("w")).agg(F.bit_or(bit).alias("bits"), F.count(F.lit(1)).alias("n"))


def containers(words: DataFrame) -> DataFrame:
    """g, c, words (word -> bits, rows before it in the container), n rows."""
    inside = Window.partitionBy("g", "c").orderBy("w").rowsBetween(Window.unboundedPreceding, -1)
    entry = F.struct(F.col("w").alias("key"), F.struct("bits", "before").alias("value"))
    return (words.where("w IS NOT NULL").withColumn("c", F.shiftright("w", CONTAINER_BITS - 6))
            .withColumn("before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
            .groupBy("g", "c").agg(F.map_from_entries(F.collect_list(entry)).alias("words"), F.sum("n").alias("n")))


def directory(counts: DataFrame) -> DataFrame:
    """g, c, base: the rows of all containers before each, by levels of directories with a bounded number of children."""
    levels, shift = [counts.select("g", F.col("c").alias("c0"), "n")], CONTAINER_BITS
    while shift < 64:
        k, shift = len(levels), shift + DIRECTORY_BITS
        levels.append(levels[-1].groupBy("g", F.shiftright(f"c{k - 1}", DIRECTORY_BITS).alias(f"c{k}")).agg(F.sum("n").alias("n")))

    def before(group: Sequence[str], child: str) -> Column:
        ahead = Window.partitionBy(*group).orderBy(child).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("n").over(ahead), F.lit(0))

    top = len(levels) - 1  # a group's one node, or two for ids of either sign
    out = levels[top].select("g", f"c{top}", before(["g"], f"c{top}").alias("base"))
    for k in range(top - 1, -1, -1):
        own = levels[k].withColumn(f"c{k + 1}", F.shiftright(f"c{k}", DIRECTORY_BITS))
        own = own.select("g", f"c{k}", f"c{k + 1}", before(["g", f"c{k + 1}"], f"c{k}").alias("b"))
        out = own.join(out, ["g", f"c{k + 1}"]).select("g", f"c{k}", (F.col("b") + F.col("base")).alias("base"))
    return out.withColumnRenamed("c0", "c")


def numbered_repeats(rows: DataFrame, words: DataFrame) -> DataFrame | None:
    """g, id, row, n, nth: the rows whose id is null or other rows' too, numbered by (leaf, row); None if there are none.

    Only words that stand for more rows than they have bits are looked at again.
    """
    full = words.where("w IS NULL OR n > bit_count(bits)").select("g", F.col("w").alias("fw"))
    if full.isEmpty():
        return None
    r, f = rows.withColumn("w", _word()).alias("r"), full.withColumnRenamed("g", "fg")
    candidates = r.join(f, (F.col("g") == F.col("fg")) & F.col("w").eqNullSafe(F.col("fw")), "left_semi").select("g", "id", "row", "leaf")
    counts = candidates.groupBy(F.col("g").alias("cg"), F.col("id").alias("cid")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR cid IS NULL")
    same = (F.col("g") == F.col("cg")) & F.col("id").eqNullSafe(F.col("cid"))
    # The row's own number ends the order, so that ranges may also be cut within equal ids and leaves.
    order = [F.col("g"), F.col("id").asc_nulls_last(), F.col("leaf"), F.col("row")]
    at = materialise(global_row_number(candidates.join(counts, same).select("g", "id", "row", "leaf", "n"), order, "at").drop("leaf"))
    first = at.groupBy(F.col("g").alias("cg"), F.col("id").alias("cid")).agg(F.min("at").alias("first"))
    return materialise(at.join(first, same).select("g", "id", "row", "n", (F.col("at") - F.col("first")).alias("nth")))


def coordinates(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All rows with their place ``at`` (0, 1, ...) in their group, and g, n of the groups."""
    words = materialise(bitmap_words(rows))
    repeats = numbered_repeats(rows, words)
    held = materialise(containers(words))
    ranked = held.select("g", "c", "words").join(directory(held.select("g", "c", "n")), ["g", "c"])
    sizes = words.groupBy("g").agg(F.sum("n").alias("n"))
    word = F.element_at("words", _word())
    place = F.col("base") + word["before"] + F.bit_count(word["bits"].bitwiseAND(_below()))
    known = (rows.where("id IS NOT NULL").withColumn("c", F.shiftright("id", CONTAINER_BITS)).join(ranked, ["g", "c"])
             .select("g", "id", "row", "leaf", "now", place.alias("at")))
    if repeats is None:
        return known, sizes
    # A word has one bit an id: rows that share a smaller id of the same word lie ahead too; then a row's own number.
    more = (repeats.where("id IS NOT NULL AND nth = 0").groupBy("g", _word().alias("w"))
            .agg(F.collect_list(F.struct(F.col("id").alias("sid"), "n")).alias("more")))
    known = known.withColumn("w", _word()).join(more, ["g", "w"], "left").join(repeats.select("row", "nth"), "row", "left")
    ahead = F.expr("coalesce(aggregate(filter(more, m -> m.sid < id), 0L, (s, m) -> s + m.n - 1), 0L)")
    known = known.select("g", "id", "row", "leaf", "now", (F.col("at") + ahead + F.coalesce("nth", F.lit(0))).alias("at"))
    start = words.groupBy("g").agg(F.coalesce(F.sum(F.when(F.col("w").isNotNull(), F.col("n"))), F.lit(0)).alias("start"))
    unknown = rows.where("id IS NULL").join(repeats.select("row", "nth"), "row").join(start, "g")
    return known.unionByName(unknown.select("g", "id", "row", "leaf", "now", (F.col("start") + F.col("nth")).alias("at"))), sizes


# -- slot arrays

def fold(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes of a slot array and of each level above it: runs of FAN become the hash of their hex digests."""
    out = [nodes]
    for _ in range(levels):
        nodes = [hashlib.sha256("".join(nodes[i:i + FAN]).encode()).hexdigest() for i in range(0, len(nodes), FAN)]
        out.append(nodes)
    return out


def siblings(tree: list[list[str]]) -> list[list[tuple[str, str]]]:
    """For each level below the top and each of its nodes: the digests of its run before it and behind it."""
    out = []
    for nodes in tree[:-1]:
        runs = [nodes[i // FAN * FAN:i // FAN * FAN + FAN] for i in range(len(nodes))]
        out.append([("".join(run[:i % FAN]), "".join(run[i % FAN + 1:])) for i, run in enumerate(runs)])
    return out


def climb(node: str, steps: Sequence[tuple[str, str]]) -> str:
    for before, behind in steps:
        node = hashlib.sha256((before + node + behind).encode()).hexdigest()
    return node


def _height(n: int) -> int:
    """Levels above n nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


_ARRAY = pa.schema([("g", pa.string()), ("block", pa.int64()), ("height", pa.int32()), ("ids", pa.list_(pa.int64())),
                    ("leaves", pa.binary()), ("nows", pa.binary()), ("top", pa.string())])
_NODES = pa.schema([("g", pa.string()), ("block", pa.int64()), ("child", pa.int64()), ("steps", _STEPS), ("top", pa.string())])


def _leaf_array(levels: int):
    """A slot array of leaves as one row, with the node it sends up."""
    def array(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        first, nodes = group.slice(0, 1).to_pylist()[0], [x.hex() for x in group["leaf"].to_pylist()]
        height = min(levels, _height(first["n"]))
        return pa.Table.from_pylist([{
            "g": first["g"], "block": first["at"] // FAN ** levels, "height": height, "ids": group["id"].to_pylist(),
            "leaves": b"".join(group["leaf"].to_pylist()), "nows": b"".join(group["now"].to_pylist()),
            "top": fold(nodes, height)[-1][0]}], _ARRAY)

    return array


def _node_array(levels: int):
    """A slot array of nodes: a row for each child with its steps inside the array, and one for the top (no child)."""
    def array(group: pa.Table) -> pa.Table:
        group = group.sort_by("at")
        first = group.slice(0, 1).to_pylist()[0]
        tree = fold(group["top"].to_pylist(), min(levels, _height(first["n"])))
        own = siblings(tree)
        rows = [{"child": at, "steps": [dict(zip(("before", "behind"), level[i // FAN ** k])) for k, level in enumerate(own)]}
                for i, at in enumerate(group["at"].to_pylist())]
        return pa.Table.from_pylist([row | {"g": first["g"], "block": first["at"] // FAN ** levels, "top": tree[-1][0]}
                                     for row in [*rows, {"child": None, "steps": []}]], _NODES)

    return array


def _reduce(nodes: DataFrame, most: int, levels: int) -> tuple[DataFrame, DataFrame]:
    """From g, at, top, n (nodes of the group, ``most`` at most): g, at, steps from each node up to the last one; g, top."""
    slots, rounds = FAN ** levels, []
    while True:
        arrays = materialise(nodes.groupBy("g", F.expr(f"at div {slots}")).applyInArrow(_node_array(levels), from_arrow_schema(_NODES)))
        rounds.append(arrays.where("child IS NOT NULL").select("g", F.col("child").alias("at"), "block", "steps"))
        tops = arrays.where("child IS NULL").select("g", F.col("block").alias("at"), "top")
        if most <= slots:
            break
        most = -(-most // slots)
        nodes = tops.join(nodes.groupBy("g").agg(F.ceil(F.max("n") / slots).alias("n")), "g")
    steps = rounds[-1].select("g", "at", "steps")
    for lower in reversed(rounds[:-1]):
        above = steps.select("g", F.col("at").alias("block"), F.col("steps").alias("upper"))
        steps = lower.join(above, ["g", "block"]).select("g", "at", F.concat("steps", "upper").alias("steps"))
    return steps, tops.select("g", "top")


_OUT = pa.schema([(c, pa.int64() if c in ("id", "leaf_index", "n_siblings") else pa.string()) for c in (
    "g", "id", "leaf_index", "leaf", "subroot", "root", "proof_sha256", "n_siblings", "folded_root")])


def _emit(root: str, slots: int):
    """Every slot of every leaf array as a row: its proof's digest, and the root folded from the document's present leaf."""
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                leaf, now = ([data[i:i + 32].hex() for i in range(0, len(data), 32)] for data in (r["leaves"], r["nows"]))
                own = siblings(fold(leaf, r["height"]))
                upper = [(s["before"], s["behind"]) for s in r["steps"] + r["root_steps"]]
                over = "".join(a + b for a, b in upper)
                rows = []
                for i, (doc, x) in enumerate(zip(r["ids"], leaf)):
                    steps = [level[i // FAN ** k] for k, level in enumerate(own)]
                    proof = "".join(a + b for a, b in steps) + over
                    rows.append({"g": r["g"], "id": doc, "leaf_index": r["block"] * slots + i, "leaf": x, "subroot": r["subroot"],
                                 "root": root, "proof_sha256": hashlib.sha256(proof.encode()).hexdigest(),
                                 "n_siblings": len(proof) // 64, "folded_root": climb(now[i], steps + upper)})
                yield pa.RecordBatch.from_pylist(rows, _OUT)

    return emit


def manifest(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """g, id, leaf_index, leaf, subroot, root, proof_sha256, n_siblings, folded_root of all ``leaves`` rows.

    Digests are lowercase hex; proof_sha256 is that of the n_siblings digests on the leaf's way to the root.
    """
    spark, rows, slots = rows.sparkSession, materialise(rows), FAN ** levels
    placed, sizes = coordinates(rows)
    sizes = materialise(sizes)
    placed = placed.select("g", "id", "leaf", "now", "at").join(sizes, "g")
    arrays = materialise(placed.groupBy("g", F.expr(f"at div {slots}")).applyInArrow(_leaf_array(levels), from_arrow_schema(_ARRAY)))
    most = sizes.agg(F.max("n")).first()[0]
    if most is None:
        return spark.createDataFrame([], from_arrow_schema(_OUT))
    blocks = F.ceil(F.col("n") / slots).alias("n")
    nodes = arrays.select("g", F.col("block").alias("at"), "top").join(sizes.select("g", blocks), "g")
    steps, subroots = _reduce(nodes, -(-most // slots), levels)
    # The groups' nodes, numbered in the order of groups, are the leaves of the last tree.
    numbered = materialise(global_row_number(subroots, [F.col("g")], "at").withColumn("at", F.col("at") - 1))
    groups = numbered.count()
    root_steps, root = _reduce(numbered.select(F.lit("").alias("g"), "at", "top", F.lit(groups).alias("n")), groups, levels)
    above = numbered.join(root_steps.select("at", F.col("steps").alias("root_steps")), "at").select("g", F.col("top").alias("subroot"), "root_steps")
    whole = (arrays.drop("top").join(steps.select("g", F.col("at").alias("block"), "steps"), ["g", "block"]).join(above, "g"))
    return whole.mapInArrow(_emit(root.first()["top"], slots), from_arrow_schema(_OUT))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(*FIELDS)
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = manifest(leaves(docs, tampered={"text": lower}, tampers=F.crc32(F.col("doc_id").cast("string")) % 3 == 0))
    return out.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root",
                      (F.col("folded_root") == F.col("root")).alias("verified"), "leaf_index", "n_siblings")


def _sql_field(name: str, value: str | None = None) -> str:
    text = value or f"CAST({name} AS VARCHAR)"
    return f"coalesce(CAST(strlen({text}) AS VARCHAR) || ':' || {text}, '-')"


#: CRC-32 of an ASCII string in SQL: the register after each byte and its eight shifts (4294967295 and 3988292384 are the
#: standard's start value and reversed polynomial).
_SQL_CRC = """xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(id, ''),
    lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s % 2 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END))"""


def _sql_level(rows: str, nodes: str, k: int) -> str:
    """CTEs that take nodes (g, p, h) and rows (g, p, now, proof) one level up."""
    return f"""
{nodes}r{k} AS MATERIALIZED (
  SELECT g, p // {FAN} AS q, list(h ORDER BY p) AS hs, any_value(n) AS n
  FROM (SELECT g, p, h, count(*) OVER (PARTITION BY g) AS n FROM {nodes}{k}) x GROUP BY g, p // {FAN}),
{nodes}{k + 1} AS MATERIALIZED (
  SELECT g, q AS p, CASE WHEN n > 1 THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM {nodes}r{k}),
{rows}{k + 1} AS MATERIALIZED (
  SELECT * EXCLUDE (hs, n, q, before, behind) REPLACE (
    p // {FAN} AS p, CASE WHEN n > 1 THEN sha256(before || now || behind) ELSE now END AS now,
    CASE WHEN n > 1 THEN proof || before || behind ELSE proof END AS proof)
  FROM (SELECT d.*, r.hs, r.n, r.q, array_to_string(hs[1:p % {FAN}], '') AS before, array_to_string(hs[p % {FAN} + 2:], '') AS behind
        FROM {rows}{k} d JOIN {nodes}r{k} r ON d.g = r.g AND d.p // {FAN} = r.q) y)"""


def _sql(levels: int = 10, group_levels: int = 5) -> str:
    fields = " || ".join(_sql_field(f) for f in FIELDS)
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    changed = " || ".join(_sql_field(f, f"CASE WHEN third THEN {lower} ELSE text END" if f == "text" else None) for f in FIELDS)
    ups = ",".join(_sql_level("d", "l", k) for k in range(levels))
    over = ",".join(_sql_level("e", "m", k) for k in range(group_levels))
    return f"""
WITH i AS (SELECT *, coalesce({_SQL_CRC} % 3 = 0, false) AS third FROM (SELECT *, CAST(doc_id AS VARCHAR) AS id FROM documents) x),
f AS (SELECT doc_id, coalesce('1' || lang, '0') AS g, sha256({fields}) AS leaf, sha256({changed}) AS now FROM i),
d0 AS MATERIALIZED (
  SELECT doc_id, g, leaf, now, '' AS proof, leaf_index, leaf_index AS p
  FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS LAST, leaf) - 1 AS leaf_index FROM f) x),
l0 AS MATERIALIZED (SELECT g, p, leaf AS h FROM d0),{ups},
s AS MATERIALIZED (SELECT g, h AS subroot, row_number() OVER (ORDER BY g) - 1 AS place FROM l{levels}),
m0 AS MATERIALIZED (SELECT '' AS g, place AS p, subroot AS h FROM s),
e0 AS MATERIALIZED (
  SELECT doc_id, leaf, leaf_index, '' AS g, s.place AS p, now, proof, s.subroot FROM d{levels} d JOIN s ON d.g = s.g),{over}
SELECT doc_id, leaf, subroot, m.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = m.h AS verified,
  leaf_index, CAST(length(proof) // 64 AS BIGINT) AS n_siblings
FROM e{group_levels} e JOIN m{group_levels} m ON e.g = m.g"""


OP11_SQL = _sql()
