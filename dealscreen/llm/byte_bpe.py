"""Byte-level BPE by prefix dynamic programming: ids of whole texts, exact decoding, appends and edits near the change.

A text is cut by the tokenizer's pattern; each match is encoded by itself. For every byte prefix of a match there is one
token with which the prefix's encoding ends: the token that ends there and may follow the last token of the prefix before
it. Two tokens may follow each other if merging their bytes gives just these two. So one pass over the prefixes, with
all vocabulary entries that end at each byte from an automaton, gives the encoding by walking back from the end; the table
of last tokens encodes every prefix as well. A match that is a vocabulary entry is this one token, as in the tokenizer's
own library. A match for which no token is valid at some prefix (impossible in a vocabulary of merges) is merged directly.

``encode``: ids (and, asked for, the table) of every row. ``decode``: the bytes of ids. ``edit``: rows whose text changes
in one place; only matches that the change can touch are encoded again, from the byte at which the first of them changes
(an append goes on with the stored table), until matches end where they ended before.

The table has one 32-bit number a byte: the last token, and a mark (``END``) where a match ends, so it needs no text
to be read. Rows are independent of each other; tokens of distinct matches are kept per worker up to a bounded size.

Defined cases: null text is empty, empty text has no ids; rows may repeat; further columns are carried in ``row``;
an edit beyond the text's end appends; a row without edit (nulls) stays as it is; an unknown id decodes to nothing.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from dealscreen.llm.common import chunks, read

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Marks the end of a match in a table; text bytes a batch; distinct matches kept, and the longest kept (characters).
END, CHUNK, KEPT, KEPT_LENGTH = 1 << 30, 1 << 20, 400_000, 48
#: Matches that a change may touch before the one it lies in: the pattern looks at most two characters beyond a match.
BACK = 3


class Vocabulary:
    """Ranks, the automaton of all entries, and which tokens may follow each other."""

    def __init__(self, path: str, pattern: str):
        import ahocorasick
        import regex

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        #: Bytes by id; ids without a token, and the last place, have none.
        self.surface = pa.array([self.tokens.get(i, b"") for i in range(max(self.tokens) + 2)], pa.binary())
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (rank, len(token)))
        self.automaton.make_automaton()
        self.pattern = regex.compile(pattern)
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, tuple[int, ...]] = {}

    def merged(self, data: bytes) -> list[int]:
        """Merge the adjacent parts with the lowest rank, the first of equals, until none is a vocabulary entry."""
        parts, ranks = [data[i:i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                break
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [ranks[p] for p in parts]

    def follows(self, before: int, token: int) -> bool:
        """Whether ``token`` may come after ``before`` (-1: at the start of a match)."""
        key = (before + 1) << 32 | token
        known = self.pairs.get(key)
        if known is None:
            data = (b"" if before < 0 else self.tokens[before]) + self.tokens[token]
            known = self.merged(data) == ([token] if before < 0 else [before, token])
            if len(self.pairs) >= 4 * KEPT:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def last_tokens(self, match: bytes, table: list[int] | None = None) -> list[int] | None:
        """The last token of each prefix of the match; ``table`` has those of its first prefixes. None: not a merge vocabulary."""
        table = list(table or ())
        known = len(table)
        table += [-1] * (len(match) - known)
        start = max(0, known - self.longest)
        for end, (token, size) in self.automaton.iter(match[start:].decode("latin-1")):
            end += start
            if end < known or table[end] >= 0 or size > end + 1:
                continue
            before = table[end - size] if end >= size else -1
            if (end < size or before >= 0) and self.follows(before, token):
                table[end] = token
        return table if -1 not in table else None

    def table(self, match: bytes, known: list[int] | None = None) -> list[int]:
        """Last tokens of the match's prefixes, the whole match as the library encodes it, its end marked."""
        whole, table = self.ranks.get(match), self.last_tokens(match, known)
        if table is None:  # each prefix merged by itself
            table = [self.merged(match[:i + 1])[-1] for i in range(len(match))]
        if whole is not None:
            table[-1] = whole
        table[-1] |= END
        return table

    def walk(self, match: bytes) -> tuple[int, ...]:
        """The ids of one match."""
        whole = self.ranks.get(match)
        if whole is not None:
            return (whole,)
        table, out, at = self.last_tokens(match), [], len(match)
        if table is None:
            return tuple(self.merged(match))
        while at:
            out.append(table[at - 1])
            at -= len(self.tokens[out[-1]])
        return tuple(reversed(out))

    def __missing__(self, match: str) -> tuple[int, ...]:
        ids = self.walk(match.encode())
        if len(match) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[match] = ids
        return ids

    def ids(self, text: str) -> list[int]:
        kept, made = self.kept, self.__missing__
        return list(chain.from_iterable([kept.get(m) or made(m) for m in self.pattern.findall(text)]))

    def text_table(self, text: str) -> np.ndarray:
        return np.array([x for m in self.pattern.findall(text) for x in self.table(m.encode())], np.int32)

    def table_ids(self, table: np.ndarray) -> list[int]:
        """The ids that a text's table stands for."""
        out, at, last = [], len(table), (table & (END - 1)).tolist()
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[out[-1]])
        return out[::-1]

    def edited(self, text: str, table: np.ndarray, start: int, stop: int, new: str) -> tuple[str, np.ndarray, int]:
        """Characters start to stop replaced by ``new``: the text, its table, and how many bytes' entries were made anew."""
        start = min(max(start, 0), len(text))
        stop = min(max(stop, start), len(text))
        after = text[:start] + new + text[stop:]
        begin = len(text[:start].encode())
        ends = np.flatnonzero(table & END) + 1
        before = ends[:max(0, int(np.searchsorted(ends, begin)) - BACK)]
        safe = int(before[-1]) if len(before) else 0  # everything up to here stays
        grown = len(after.encode()) - len(text.encode())
        resume, old = begin + len(new.encode()), text.encode()
        ended = set(ends[ends >= begin + len(text[start:stop].encode())].tolist())
        out, at, made = [table[:safe]], safe, 0
        chars = len(old[:safe].decode())
        for m in self.pattern.finditer(after, chars):
            if at >= resume and at - grown in ended:
                out.append(table[at - grown:])
                break
            match = m.group().encode()
            # Entries of the old match at the same place hold as far as the bytes agree, but for its last one.
            i = int(np.searchsorted(ends, at, "right"))
            same = 0
            if at <= begin and i < len(ends):
                limit = min(len(match), int(ends[i]) - at - 1, begin - at)
                same = limit if at + limit <= begin else 0
            known = (table[at:at + same] & (END - 1)).tolist() if same > 0 else []
            out.append(np.array(self.table(match, known), np.int32))
            made += len(match) - len(known)
            at += len(match)
        return after, np.concatenate(out), made


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def defaults() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path(RANKS), public_tokenizers.PATTERN


def _lists(rows: list, dtype) -> pa.ListArray:
    """Lists of 32-bit numbers as one Arrow array."""
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows], dtype=np.int64)])
    flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, dtype))


def _run(df: DataFrame, work, extra: pa.Schema, text: str) -> DataFrame:
    """``row`` and further columns that ``work(batch)`` makes of each slice of bounded bytes."""
    kind = to_arrow_type(df.schema["row"].dataType)
    schema = pa.schema([("row", kind), *extra])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, text, CHUNK):
            yield pa.RecordBatch.from_arrays([b.column("row").cast(kind), *work(b)], schema=schema)

    return df.mapInArrow(run, from_arrow_schema(schema))


def encode(docs: DataFrame, text: str = "text", table: bool = False, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """row (the document), ids and, with ``table``, the last token of every byte prefix (32-bit little endian)."""
    known = (path or defaults()[0], pattern or defaults()[1])

    def work(b: pa.RecordBatch) -> list[pa.Array]:
        v, texts = vocabulary(*known), [t or "" for t in b.column("text").to_pylist()]
        if not table:
            return [_lists([v.ids(t) for t in texts], pa.int32())]
        tables = [v.text_table(t) for t in texts]
        return [_lists([v.table_ids(t) for t in tables], pa.int32()), pa.array([t.astype("<i4").tobytes() for t in tables], pa.binary())]

    extra = [("ids", pa.list_(pa.int32())), *([("last", pa.binary())] if table else [])]
    return _run(docs.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text")), work, pa.schema(extra), "text")


def decode(rows: DataFrame, ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """row (all columns of the input) and ``decoded``, the bytes of its ids."""
    known = (path or defaults()[0], pattern or defaults()[1])

    def work(b: pa.RecordBatch) -> list[pa.Array]:
        surface, lists = vocabulary(*known).surface, pa.concat_arrays([b.column("ids")])
        flat = lists.flatten().fill_null(-1).to_numpy()
        parts = surface.take(pa.array(np.where((flat < 0) | (flat >= len(surface)), len(surface) - 1, flat)))
        data = b"".join(parts.to_pylist()) if parts.offset else parts.buffers()[2]
        # Where each token's bytes and each row's ids begin.
        bytes_at = np.concatenate([[0], np.cumsum(pc.binary_length(parts).to_numpy(), dtype=np.int64)])
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        offsets = bytes_at[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])].astype(np.int32)
        return [pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets.tobytes()), data or pa.py_buffer(b"")])]

    rows = rows.select(F.struct("*").alias("row"), F.col(ids).alias("ids"), F.lit(None).cast("string").alias("text"))
    return _run(rows, work, pa.schema([("decoded", pa.binary())]), "text")


def edit(rows: DataFrame, text: str = "text", last: str = "last", start: str = "start", stop: str = "stop", new: str = "new",
         path: str | None = None, pattern: str | None = None) -> DataFrame:
    """row, new_text, ids, last and n_made (entries made anew) of rows whose characters start to stop become ``new``.

    ``last`` is the table from ``encode`` or an earlier edit; a null start leaves the row as it is, a null ``new`` is empty.
    """
    known = (path or defaults()[0], pattern or defaults()[1])

    def work(b: pa.RecordBatch) -> list[pa.Array]:
        v, out = vocabulary(*known), []
        for r in b.select(["text", "last", "start", "stop", "new"]).to_pylist():
            old, table = r["text"] or "", np.frombuffer(r["last"] or b"", "<i4").astype(np.int32)
            out.append((old, table, 0) if r["start"] is None else
                       v.edited(old, table, r["start"], r["start"] if r["stop"] is None else r["stop"], r["new"] or ""))
        return [pa.array([o[0] for o in out], pa.string()), _lists([v.table_ids(o[1]) for o in out], pa.int32()),
                pa.array([o[1].astype("<i4").tobytes() for o in out], pa.binary()), pa.array([o[2] for o in out], pa.int64())]

    rows = rows.select(F.struct("*").alias("row"), F.col(text).cast("string").alias("text"), F.col(last).alias("last"),
                       F.col(start).cast("long").alias("start"), F.col(stop).cast("long").alias("stop"), F.col(new).cast("string").alias("new"))
    extra = pa.schema([("new_text", pa.string()), ("ids", pa.list_(pa.int32())), ("last", pa.binary()), ("n_made", pa.int64())])
    return _run(rows, work, extra, "text")


def digest(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of ``encode``'s rows, the ids decoded again."""
    decoded = decode(encoded.select(F.col("row.doc_id").alias("doc_id"), "ids"))
    return decoded.select(F.col("row.doc_id").alias("doc_id"), F.size("row.ids").cast("long").alias("n_tokens"),
                          F.sha2(F.array_join(F.col("row.ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(encode(read(spark, sf_dir, "documents").select("doc_id", "text")))
