"""Byte-level BPE by prefix tables against the tokenizer's own library."""

import base64
import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import public_tokenizers
import tiktoken
from dealscreen.llm import byte_bpe

ALPHABET = ["a", "b", "the", " ", "  ", "\n", "\t", "'s", "'", "é", "ß", "中", "文", "😀", "1", "23", "!", "...", " ", "x" * 30, "ing", "\x00", "R"]


@pytest.fixture(scope="module")
def library():
    with open(public_tokenizers.path(byte_bpe.RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def v():
    return byte_bpe.vocabulary(*byte_bpe.defaults())


def random_text(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def sample_texts():
    rng = random.Random(2)
    given = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    made = [random_text(rng, rng.randrange(0, 60)) for _ in range(300)]
    return given + made + ["", "a" * 5000, " " * 3000, "\n" * 999 + "x", "ab" * 4000, "é" * 2000, "<|endoftext|> x",
                           "".join(chr(rng.randrange(32, 0xD000)) for _ in range(3000))]


def test_ids_are_the_librarys(v, library):
    for t in sample_texts():
        assert v.ids(t) == library.encode_ordinary(t)


def test_every_entry_and_random_bytes(v, library):
    """All vocabulary entries that are text, alone and doubled; no prefix has two valid last tokens."""
    for token in v.ranks:
        try:
            t = token.decode()
        except UnicodeDecodeError:
            continue
        assert v.ids(t) == library.encode_ordinary(t) and v.ids(t + t) == library.encode_ordinary(t + t)


def test_tables_encode_every_prefix(v):
    for word in [w for t in sample_texts()[:40] for w in t.split()[:6]] + ["aaaaaaaaaaaa", "中文中文é"]:
        data = word.encode()[:40]
        table = v.last_tokens(data)
        for end in range(1, len(data) + 1):
            ids, at = [], end
            while at:
                ids.append(table[at - 1])
                at -= len(v.tokens[ids[-1]])
            assert ids[::-1] == v.merged(data[:end])
            valid = [t for t, n in ((t, len(b)) for t, b in ((v.ranks.get(data[s:end]), data[s:end]) for s in range(end)) if t is not None)
                     if v.follows(table[end - n - 1] if end > n else -1, t)]
            assert len(valid) == 1


def test_edits_are_exact_and_near(v):
    rng = random.Random(9)
    for _ in range(400):
        text = random_text(rng, rng.randrange(0, 80))
        table = v.text_table(text)
        for _ in range(3):
            start = rng.randrange(0, len(text) + 1)
            stop = min(len(text), start + rng.choice([0, 0, 1, 5]))
            new = random_text(rng, rng.choice([0, 1, 4]))
            text, table, _ = v.edited(text, table, start, stop, new)
            assert np.array_equal(table, v.text_table(text)), (text, start, stop, new)
            assert v.table_ids(table) == v.ids(text)
    long = " ".join(f"word{i}" for i in range(5000))
    table = v.text_table(long)
    assert v.edited(long, table, 20000, 20003, "new")[2] < 100
    assert v.edited(long, table, len(long), len(long), "s and more")[2] < 100
    one = "x" * 20000
    assert v.edited(one, v.text_table(one), 20000, 20000, "y")[2] <= 2


def expected(texts, library):
    out = []
    for d, t in texts:
        ids = library.encode_ordinary(t or "")
        out.append((d, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_operator(spark, docs, texts, no_docs, library):
    assert sorted(map(tuple, byte_bpe.digest(byte_bpe.encode(docs)).collect()), key=str) == expected(texts, library)
    assert byte_bpe.digest(byte_bpe.encode(no_docs)).count() == 0
    kept = byte_bpe.encode(docs).select("row.*")
    assert kept.columns == docs.columns and sorted(map(str, kept.collect())) == sorted(map(str, docs.collect()))


def test_registered_query(spark, sf_dir, library):
    given = pq.read_table(f"{sf_dir}/documents.parquet").to_pylist()
    out = byte_bpe.op12_byte_bpe(spark, sf_dir).collect()
    assert sorted(map(tuple, out), key=str) == expected([(r["doc_id"], r["text"]) for r in given], library)


def test_edit_operator(spark, docs, v):
    """Edits of rows: tables made by encode, changed twice, are those of the new texts."""
    rows = byte_bpe.encode(docs, table=True).select("row.*", "last").withColumns({
        "start": F.when(F.col("doc_id") % 5 != 0, F.length("text") - 3), "stop": F.length("text") - F.lit(1), "new": F.lit("Zé z")})
    once = byte_bpe.edit(rows).select("new_text", "ids", "last", "n_made", F.lit(0).alias("start"), F.lit(None).cast("int").alias("stop"),
                                      F.lit("  ").alias("new"))
    for r in once.collect():
        assert r.ids == v.ids(r.new_text) and np.array_equal(np.frombuffer(r.last, "<i4"), v.text_table(r.new_text))
    for r in byte_bpe.edit(once, text="new_text").collect():
        assert r.new_text.startswith("  ") and r.ids == v.ids(r.new_text)


def test_decode(spark, v):
    rows = [(1, [50, None, -3, 10**6, 300]), (2, None), (3, []), (4, [17])]
    out = {r.row.k: bytes(r.decoded) for r in byte_bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>")).collect()}
    assert out == {1: v.tokens[50] + v.tokens[300], 2: b"", 3: b"", 4: v.tokens[17]}
