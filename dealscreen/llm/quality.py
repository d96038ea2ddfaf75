"""Quality rules with an n-gram perplexity band: a bigram model with modified Kneser-Ney smoothing.

Every language has a model of its own, that other languages' text doesn't change: its vocabulary are the words found
twice or more; all bigrams count; its discounts come from the counts of counts of its bigrams, and its texts have their
own start. The model grows with the corpus and is never in one place (``perplexities``): a chunk of documents is split
into words once and sends its distinct words to buckets by hash, which number them; then its distinct bigrams to buckets
by hash, which add them up; these send what they add to a word's contexts to the word's bucket. A bucket gives every chunk
what it asked for, in the chunk's own order, and the chunk scores its texts. So a bigram that a third of all documents
share is one entry a chunk. On the driver are sums by language and the vocabulary's size by language and bucket.

A word outside the vocabulary is the language's unknown word, spread evenly over its distinct unknown words. Scores are
log10 perplexities per word. Each language has its own band, from all its documents that pass the base rules: up to
``WIDTH`` robust deviations (quartiles / 1.349) above their median, and down to ``LOW_SHARE`` of the median (text that
is merely copied often is familiar to the model without being bad, so the lower end is wide). Outside of it a document
is rejected. Languages without such a document reject nothing by perplexity.

``train`` gives the same model as one object, for a corpus whose distinct bigrams fit a process; no operator uses it.

Base rules: fewer than 50 words, or over half of the words in 3-word windows found twice or more.

Defined cases: null and empty texts have no words (all counts 0, base_failed, perplexity null); null languages are a
language of their own; repeated rows count as often as they occur; other columns are ignored or, in the stage, kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from dealscreen.llm.common import (chunks, coded, discard, freed, materialise, materialise_buckets, mix, pack, read, rows_of,
                                   returned, scratch_dir, shuffle_partitions, split_words, unpack)
from dealscreen.llm.substrings import _hashes

KNOWN, WIDTH, LOW_SHARE, MIN_WORDS = 2, 6.0, 0.15, 50
SALTS = 64
BUCKET, CHUNK, BASE_WORDS = 1 << 21, 8 << 20, 1 << 17  # words a bucket of bigrams, bytes a chunk, words counted at once
PASSES = 4  # the bigrams are sent in so many passes, each with a share of the buckets, so that less is shuffled at once
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
START = 0  # a text's start in any language; each language's ids are its own start, its unknown word, its vocabulary
APART = -99.0  # log10 probability of a word after another language's


def _langs(b: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    d = pc.fill_null(b.column("lang").cast(pa.string()), "").dictionary_encode()
    return d.indices.to_numpy(), d.dictionary.to_pylist()


def count_words(docs: DataFrame) -> DataFrame:
    """lang, word, n: exact word counts over all documents."""
    def count(batches):
        for b in chunks(batches):
            code, langs = _langs(b)
            for i, lang in enumerate(langs):
                words, _ = split_words(b.column("text").filter(pa.array(code == i)))
                found = words.value_counts()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), found.field(0), found.field(1)],
                    names=["lang", "word", "n"])

    return (docs.select("text", "lang").mapInArrow(count, "lang string, word string, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


class Vocabulary:
    """Words with an id, and by language the unknown word's id and how many distinct words it stands for."""

    def __init__(self, rows: list, langs: list):
        self.unknown, self.spread, self.words, self.starts = {}, {}, {}, [0]
        by = {}
        for lang, word in sorted(rows):
            by.setdefault(lang, []).append(word)
        at = 1
        for lang, n_types in sorted(langs):
            words = by.get(lang, [])
            self.starts.append(at)
            self.unknown[lang], self.spread[lang] = at + 1, max(1, n_types - len(words))
            self.words[lang] = (pa.array(words, pa.string()), at + 2)
            at += 2 + len(words)
        self.size = at

    def language(self, ids: np.ndarray) -> np.ndarray:
        """Languages' numbers from 1 on; 0 for the start in any language."""
        return np.searchsorted(self.starts, ids, side="right") - 1

    def ids(self, distinct: pa.Array, lang: str) -> np.ndarray:
        words, first = self.words.get(lang, (pa.array([], pa.string()), 0))
        found = pc.index_in(distinct, value_set=words).to_numpy(zero_copy_only=False)
        return np.where(np.isnan(found), self.unknown.get(lang, START), np.nan_to_num(found) + first).astype(np.int64)


def _id_bigrams(ids: np.ndarray, offsets: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """First and second word of every bigram of the texts; the first bigram of a text has its language's start before it."""
    before = np.concatenate([[START], ids[:-1]])
    at = offsets[:-1][np.diff(offsets) > 0]
    before[at] = np.array(vocabulary.starts)[vocabulary.language(ids[at])]
    return before, ids


def _count_bigrams(docs: DataFrame, vocabulary, buckets: int) -> DataFrame:
    """bucket, keys, ns: each task's distinct bigrams (first << 32 | second), sorted and delta-coded, and their counts."""
    def count(batches):
        held, size = [], 0

        def send():
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            ns = np.bincount(inverse, weights=np.concatenate([n for _, n in held])).astype(np.uint32)
            part = (mix(keys >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(buckets + 1))
            rows = [(i, pack(np.diff(keys[order[a:z]], prepend=np.uint64(0))), pack(ns[order[a:z]]))
                    for i, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()),
                                               pa.array([r[1] for r in rows], pa.binary()),
                                               pa.array([r[2] for r in rows], pa.binary())],
                                              names=["bucket", "keys", "ns"])

        for b in chunks(batches):
            code, langs = _langs(b)
            for i, lang in enumerate(langs):
                words, offsets = split_words(b.column("text").filter(pa.array(code == i)))
                codes, distinct = coded(words)
                if len(codes):
                    a, z = _id_bigrams(vocabulary.value.ids(distinct, lang)[codes], offsets, vocabulary.value)
                    keys, ns = np.unique((a.astype(np.uint64) << np.uint64(32)) | z.astype(np.uint64), return_counts=True)
                    held.append((keys, ns))
                    size += len(keys)
            if size > 4_000_000:
                yield send()
                held, size = [], 0
        if held:
            yield send()

    return docs.select("text", "lang").mapInArrow(count, "bucket int, keys binary, ns binary")


def _contexts(starts: list):
    """One bucket's bigrams merged, packed: counts of counts, statistics of each context, bigrams, seconds' contexts."""
    def merge(table: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in table["keys"].to_pylist()])
        weights = np.concatenate([unpack(n, np.uint32) for n in table["ns"].to_pylist()])
        keys, inverse = np.unique(keys, return_inverse=True)
        ns = np.bincount(inverse, weights=weights).astype(np.int64)
        first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        lang = np.searchsorted(starts, first, side="right") - 1
        out = []

        def add(kind, a, b, n):
            out.append((kind, *(pack(np.asarray(x).astype(np.int64)) for x in (a, b, n))))

        for c in range(1, 5):
            n = np.bincount(lang[ns == c], minlength=len(starts))
            add("count", np.full(len(starts), c), np.arange(len(starts)), n)
        heads, start = np.unique(first, return_index=True)
        add("total", heads, np.zeros(len(heads)), np.add.reduceat(ns, start))
        for c in (1, 2, 3):
            own = (ns == c) if c < 3 else (ns >= 3)
            add("types", heads, np.full(len(heads), c), np.add.reduceat(own.astype(np.int64), start))
        seconds, n = np.unique(second, return_counts=True)
        add("before", seconds, np.zeros(len(seconds)), n)
        add("bigram", first, second, ns)
        return pa.table([pa.array([r[0] for r in out], pa.string()), *[pa.array([r[i] for r in out], pa.binary()) for i in (1, 2, 3)]],
                        names=["kind", "a", "b", "n"])

    return merge


def _discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2 and more; small fixed ones where counts of counts are missing."""
    if min(n1, n2, n3, n4) <= 0:
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0, [0, 1, 2, 3])


class Model:
    """Log10 probabilities: of words (array by id), stored bigrams (sorted hashes), and each context's back-off."""

    def __init__(self, rows, vocabulary: Vocabulary):
        size, langs = vocabulary.size, len(vocabulary.starts)
        self.vocabulary, self.lang = vocabulary, vocabulary.language(np.arange(vocabulary.size))
        counts, total, types, before = np.zeros((langs, 5)), np.zeros(size), np.zeros((size, 4)), np.zeros(size)
        pairs = [(np.empty(0, np.uint32), np.empty(0, np.uint32), np.empty(0, np.uint32))]
        # One bucket's rows at a time; a bucket has whole contexts, and some of each word's contexts before it.
        for r in rows:
            a, b, n = (unpack(r[c], np.int64) for c in ("a", "b", "n"))
            if r["kind"] == "count":
                np.add.at(counts, (b, a), n)
            elif r["kind"] == "total":
                total[a] = n
            elif r["kind"] == "types":
                types[a, b] = n
            elif r["kind"] == "before":
                before[a] += n
            else:
                pairs.append((a.astype(np.uint32), b.astype(np.uint32), np.minimum(n, 2**32 - 1).astype(np.uint32)))
        d = np.stack([_discounts(*c[1:]) for c in counts])
        own = np.stack([_discounts(*[float((before[self.lang == i] == c).sum()) for c in range(1, 5)]) for i in range(langs)])
        # Lower order: discounted numbers of distinct contexts, the rest spread evenly over the language's words.
        cut = own[self.lang, np.minimum(before, 3).astype(int)]
        every = np.maximum(np.bincount(self.lang, weights=before, minlength=langs), 1)
        freed = np.bincount(self.lang, weights=cut * (before > 0), minlength=langs) / every
        words = np.maximum(np.bincount(self.lang, minlength=langs) - 1, 1)
        alone = np.maximum(before - cut, 0) / every[self.lang] + (freed / words)[self.lang]
        alone[vocabulary.starts] = 0
        alone = np.maximum(alone, 1e-12)
        first, second, n = (np.concatenate([x[i] for x in pairs]).astype(np.int64) for i in range(3))
        del pairs
        direct = (n - d[self.lang[first], np.minimum(n, 3)]) / total[first] if len(first) else np.empty(0)
        rest = np.ones(size)
        np.subtract.at(rest, first, direct)
        rest = np.clip(rest, 1e-9, 1)
        full = direct + rest[first] * alone[second] if len(first) else np.empty(0)
        keys = mix((first.astype(np.uint64) << np.uint64(32)) | second.astype(np.uint64))
        order = np.argsort(keys)
        self.keys, self.bigrams = keys[order], np.log10(full[order]).astype(np.float32)
        self.words, self.back_off = np.log10(alone).astype(np.float32), np.log10(rest).astype(np.float32)
        self.unknown = np.zeros(size, np.float32)
        for lang, i in vocabulary.unknown.items():
            self.unknown[i] = np.log10(vocabulary.spread[lang])
        # The start in any language is followed by a language's own with its share of texts.
        self.share = np.zeros(size, np.float32)
        starts = np.array(vocabulary.starts[1:], np.int64)
        self.share[starts] = np.log10(np.maximum(total[starts], 1) / np.maximum(total[starts], 1).sum())

    def log10(self, ids: np.ndarray, offsets: np.ndarray, languages: bool = True) -> np.ndarray:
        """Log10 probability of every word after the one before it; a text's first has its language's too, if asked for."""
        a, z = _id_bigrams(ids, offsets, self.vocabulary)
        out = np.where(self.lang[a] == self.lang[z], self.back_off[a] + self.words[z], APART)
        if len(self.keys):
            key = mix((a.astype(np.uint64) << np.uint64(32)) | z.astype(np.uint64))
            slot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out = np.where(self.keys[slot] == key, self.bigrams[slot], out)
        out = out - self.unknown[z]
        if languages:
            at = offsets[:-1][np.diff(offsets) > 0]
            out[at] += self.share[a[at]]
        return out


def train(docs: DataFrame) -> Model:
    """The whole model in one process."""
    spark = docs.sparkSession
    counts = materialise(count_words(docs))
    langs = sorted(tuple(r) for r in counts.groupBy("lang").agg(F.sum("n"), F.count("*")).collect())
    known = counts.where(F.col("n") >= KNOWN)
    vocabulary = Vocabulary([tuple(r) for r in known.select("lang", "word").collect()], [(x, n) for x, _, n in langs])
    sent = spark.sparkContext.broadcast(vocabulary)
    merged = materialise(_count_bigrams(docs, sent, 2 * shuffle_partitions(spark)).groupBy("bucket").applyInArrow(
        _contexts(vocabulary.starts), "kind string, a binary, b binary, n binary"))
    return Model(merged.toLocalIterator(), vocabulary)


def _repeats(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Words of each text in 3-word windows that the text has twice or more."""
    n = len(offsets) - 1
    if len(codes) < 3:
        return np.zeros(n, np.int64)
    row = rows_of(offsets)
    inside = np.flatnonzero(row[2:] == row[:-2])
    if not len(inside):
        return np.zeros(n, np.int64)
    # Exact: pairs of words get dense numbers, then (row, pair, word) is compared as a whole.
    words = np.uint64(codes.max() + 1)
    pair = np.unique(codes[inside].astype(np.uint64) * words + codes[inside + 1].astype(np.uint64), return_inverse=True)[1]
    window = np.unique(pair.astype(np.uint64) * words + codes[inside + 2].astype(np.uint64), return_inverse=True)[1]
    key = row[inside].astype(np.uint64) * np.uint64(window.max() + 1) + window.astype(np.uint64)
    _, inverse, ns = np.unique(key, return_inverse=True, return_counts=True)
    at = inside[ns[inverse] > 1]
    covered = np.zeros(len(codes), bool)
    for j in range(3):
        covered[at + j] = True
    return np.bincount(row[covered], minlength=n)


def _dup_lines(text: str) -> int:
    lines = [x for x in text.encode().split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    return len(lines) - len(set(lines))


def _characters(words: pa.Array, offsets: np.ndarray) -> np.ndarray:
    ends = np.concatenate([[0], np.cumsum(pc.utf8_length(words).to_numpy(zero_copy_only=False), dtype=np.int64)])
    return ends[offsets[1:]] - ends[offsets[:-1]]


def _symbols(texts: pa.Array) -> list[int]:
    return [int(SYMBOLS[np.frombuffer(t.encode(), np.uint8)].sum()) if t else 0 for t in texts.to_pylist()]


def _base(texts: pa.Array, words: pa.Array, codes: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Base counts and base_failed of each text, of some BASE_WORDS words (a longer text alone) at a time."""
    out, a = [], 0
    while not out or a < len(texts):
        z = min(len(texts), max(a + 1, int(np.searchsorted(offsets, offsets[a] + BASE_WORDS, side="right")) - 1))
        lo, hi = int(offsets[a]), int(offsets[z])
        out.append(_base_part(texts.slice(a, z - a), words.slice(lo, hi - lo), codes[lo:hi], offsets[a:z + 1] - lo))
        a = z
    return {c: np.concatenate([x[c] for x in out]) for c in out[0]}


def _base_part(texts: pa.Array, words: pa.Array, codes: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n_words, repeats = np.diff(offsets), _repeats(codes, offsets)
    return {"n_words": n_words, "word_chars": _characters(words, offsets), "n_symbols": np.array(_symbols(texts)),
            "n_dup_lines": np.array([_dup_lines(t) if t else 0 for t in texts.to_pylist()]), "n_repeat_words": repeats,
            "base_failed": (n_words < MIN_WORDS) | (100 * repeats > 50 * n_words)}


def _per_word(log10: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Log10 perplexity of each text; nan without words."""
    n = len(offsets) - 1
    sums = np.bincount(rows_of(offsets), weights=log10, minlength=n) if len(log10) else np.zeros(n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.diff(offsets) > 0, -sums / np.diff(offsets), np.nan)


def measures(b: pa.RecordBatch, model: Model) -> dict[str, np.ndarray]:
    """Base counts, base_failed and perplexity (log10 per word, nan without words) of each row."""
    words, offsets = split_words(b.column("text"))
    codes, distinct = coded(words)
    code, langs = _langs(b)
    ids = np.zeros(len(codes), np.int64)
    row = rows_of(offsets)
    for i, lang in enumerate(langs):
        own = code[row] == i
        ids[own] = model.vocabulary.ids(distinct, lang)[codes[own]]
    return _base(b.column("text"), words, codes, offsets) | {
        "perplexity": _per_word(model.log10(ids, offsets, languages=False), offsets)}


_NUMBERS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def scored(docs: DataFrame, model) -> DataFrame:
    """doc_id, lang and the measures of every document row."""
    def score(batches):
        for b in chunks(batches):
            m = measures(b, model.value)
            lang = pc.fill_null(b.column("lang").cast(pa.string()), "")
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), lang, *[pa.array(m[c], pa.int64()) for c in _NUMBERS],
                 pa.array(m["base_failed"], pa.bool_()),
                 pa.array(m["perplexity"], pa.float64(), mask=np.isnan(m["perplexity"]))],
                names=["doc_id", "lang", *_NUMBERS, "base_failed", "perplexity"])

    rows = docs.select("doc_id", "text", "lang")
    return rows.mapInArrow(score, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang string, "
                           + ", ".join(f"{c} long" for c in _NUMBERS) + ", base_failed boolean, perplexity double")


# -- the model in Spark -------------------------------------------------------------------------------------------------

_SENT = "array<struct<place:int,bucket:int,lang:string,h:binary,n:binary>>"
_STATE = f"n_words long, offsets binary, codes binary, numbers binary, failed binary, sent {_SENT}"
_WORDS = "bucket int, chunk long, place int, lang string, ranks binary"
_BIGRAMS = "kind string, bucket int, chunk long, lang string, ranks binary, stats binary"
_FACTS = 5  # of a word: distinct words before it, occurrences as context, words once, twice and more often after it


def _state(buckets: int, kinds: list):
    """A chunk's rows, base counts, words by number and each distinct word of a language once, by bucket of its hash."""
    sent = pa.list_(pa.struct([("place", pa.int32()), ("bucket", pa.int32()), ("lang", pa.string()), ("h", pa.binary()),
                               ("n", pa.binary())]))

    def run(batches):
        for b in chunks(batches, limit=CHUNK):
            words, offsets = split_words(b.column("text"))
            codes, distinct = coded(words)
            base = _base(b.column("text"), words, codes, offsets)
            code, langs = _langs(b)
            size = max(len(distinct), 1)
            found, inverse = np.unique(code[rows_of(offsets)].astype(np.int64) * size + codes, return_inverse=True)
            h, lang = _hashes(distinct)[found % size] if len(found) else np.empty(0, np.uint64), found // size
            order = np.lexsort((h, lang))
            number = np.empty(len(found), np.int64)
            number[order] = np.arange(len(found))
            codes, h, lang = number[inverse], h[order], lang[order]
            n = np.minimum(np.bincount(codes, minlength=len(found)), KNOWN).astype(np.uint8)
            place = lang * buckets + ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            heads = np.flatnonzero(np.diff(place, prepend=-1))
            out = [{"place": i, "bucket": int(place[a] % buckets), "lang": langs[lang[a]],
                    "h": pack(np.diff(h[a:z], prepend=np.uint64(0))), "n": pack(n[a:z])}
                   for i, (a, z) in enumerate(zip(heads, np.append(heads[1:], len(found))))]
            numbers = np.stack([base[c] for c in _NUMBERS]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([b.column(c).to_pylist()], pa.list_(b.schema.field(c).type)) for c in kinds]
                + [pa.array([len(codes)], pa.int64())] + [pa.array([x], pa.binary()) for x in (pack(offsets), pack(codes.astype(np.uint32)), pack(numbers.ravel()),
                                                        pack(base["base_failed"].astype(np.uint8)))]
                + [pa.array([out], sent)], names=[*kinds, "n_words", "offsets", "codes", "numbers", "failed", "sent"])

    return run


def _number_words(table: pa.Table) -> pa.Table:
    """A bucket's words of each language numbered from 1 on (0: not in the vocabulary), given back to every chunk; chunk -1:
    how many are in the vocabulary, and how many are not."""
    rows, langs = [], np.array(table["lang"].to_pylist(), object)
    chunk, place, bucket = table["chunk"].to_pylist(), table["place"].to_pylist(), table["bucket"][0].as_py()
    for lang in sorted(set(langs)):
        at = np.flatnonzero(langs == lang)
        hashes = [np.cumsum(unpack(table["h"][int(i)].as_py(), np.uint64), dtype=np.uint64) for i in at]
        distinct, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([unpack(table["n"][int(i)].as_py(), np.uint8) for i in at]))
        known = n >= KNOWN
        number = np.where(known, np.cumsum(known), 0).astype(np.uint32)
        ends = np.cumsum([len(x) for x in hashes])
        rows += [(chunk[i], place[i], lang, pack(number[inverse[a:z]])) for i, a, z in zip(at, np.append(0, ends[:-1]), ends)]
        rows.append((-1, -1, lang, pack(np.array([known.sum(), len(known) - known.sum()]))))
    return pa.table([pa.array([bucket] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int64()),
                     pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()),
                     pa.array([r[3] for r in rows], pa.binary())], names=["bucket", "chunk", "place", "lang", "ranks"])


class Numbering:
    """The words' numbers: of each language its start, its unknown word and its vocabulary by bucket, one after the other."""

    def __init__(self, sizes: dict, buckets: int):
        # sizes: (lang, bucket): words in the vocabulary, others.
        self.langs = sorted({lang for lang, _ in sizes})
        self.at = {lang: i + 1 for i, lang in enumerate(self.langs)}
        known = np.array([[sizes.get((x, b), (0, 0)) for b in range(buckets)] for x in self.langs], np.int64).reshape(-1, buckets, 2)
        words = known[:, :, 0].sum(axis=1)
        ends = 1 + np.cumsum(2 + words)
        self.buckets, self.size = buckets, int(ends[-1]) if len(ends) else 1
        self.starts = np.append(0, ends - 2 - words)
        self.unknown = np.append(0, self.starts[1:] + 1)
        self.words = np.append(0, words)
        self.spread = np.append(1, np.maximum(known[:, :, 1].sum(axis=1), 1))
        self.first = (self.starts[1:] + 2)[:, None] + np.cumsum(known[:, :, 0], axis=1) - known[:, :, 0]

    def language(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, ids, side="right") - 1

    def ids(self, found: list) -> np.ndarray:
        """A chunk's distinct words' ids, from its buckets' answers in order."""
        out = [np.empty(0, np.int64)]
        for x in found:
            i, rank = self.at[x["lang"]], unpack(x["ranks"], np.uint32).astype(np.int64)
            out.append(np.where(rank > 0, self.first[i - 1, x["bucket"]] + rank - 1, self.unknown[i]))
        return np.concatenate(out)


def _bigrams(ids: np.ndarray, codes: np.ndarray, offsets: np.ndarray, numbering: Numbering, buckets: int, share: int | None = None):
    """A chunk's distinct bigrams by bucket (sorted in each; of one pass only, if asked for), every word's number among
    them, and the buckets' bounds."""
    a, z = _id_bigrams(ids[codes], offsets, numbering)
    keys = (a.astype(np.uint64) << np.uint64(32)) | z.astype(np.uint64)
    if share is not None:
        keys = keys[mix(keys) % np.uint64(buckets) % np.uint64(PASSES) == share]
    keys, inverse = np.unique(keys, return_inverse=True)
    part = (mix(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    number = np.empty(len(keys), np.int64)
    number[order] = np.arange(len(keys))
    return keys[order], number[inverse], np.searchsorted(part[order], np.arange(buckets + 1))


def _send_bigrams(sent, buckets: int, share: int):
    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                found = sorted(r["found"], key=lambda x: x["place"])
                keys, number, cuts = _bigrams(sent.value.ids(found), unpack(r["codes"], np.uint32), unpack(r["offsets"], np.int64),
                                              sent.value, buckets, share)
                ns = np.bincount(number, minlength=len(keys)).astype(np.uint32)
                rows = [(i, pack(np.diff(keys[a:z], prepend=np.uint64(0))), pack(ns[a:z]))
                        for i, (a, z) in enumerate(zip(cuts, cuts[1:])) if z > a]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in rows], pa.int32()), pa.array([r["chunk"]] * len(rows), pa.int64()),
                     pa.array([x[1] for x in rows], pa.binary()), pa.array([x[2] for x in rows], pa.binary())],
                    names=["bucket", "chunk", "keys", "ns"])

    return run


def _total_bigrams(sent):
    """A bucket's bigrams added up: ``n`` their counts for every chunk; ``word`` what they add to the facts of words, by the
    words' buckets; ``sum`` by language the counts of counts and the facts of its start and unknown word."""
    def run(table: pa.Table) -> pa.Table:
        numbering, bucket = sent.value, table["bucket"][0].as_py()
        given = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in table["keys"].to_pylist()]
        keys, inverse = np.unique(np.concatenate(given), return_inverse=True)
        ns = np.bincount(inverse, weights=np.concatenate([unpack(n, np.uint32) for n in table["ns"].to_pylist()])).astype(np.int64)
        ends, answer = np.cumsum([len(k) for k in given]), np.minimum(ns, 2**32 - 1).astype(np.uint32)
        rows = [("n", bucket, c, None, pack(answer[inverse[a:z]]), None)
                for c, a, z in zip(table["chunk"].to_pylist(), np.append(0, ends[:-1]), ends)]
        first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        ids, place = np.unique(np.concatenate([first, second]), return_inverse=True)
        place, facts = np.split(place, [len(first)]), np.zeros((_FACTS, len(ids)), np.int64)
        facts[0] = np.bincount(place[1], minlength=len(ids))
        facts[1] = np.bincount(place[0], weights=ns, minlength=len(ids))
        for c in (1, 2, 3):
            facts[1 + c] = np.bincount(place[0][(ns == c) if c < 3 else (ns >= 3)], minlength=len(ids))
        lang, size = numbering.language(ids), len(numbering.starts)
        sums = np.zeros((size, 4 + 2 * _FACTS), np.int64)
        for c in range(1, 5):
            sums[:, c - 1] = np.bincount(numbering.language(first[ns == c]), minlength=size)
        offset = ids - numbering.starts[lang]
        for i in (0, 1):
            at = np.flatnonzero(offset == i)
            sums[lang[at], 4 + i * _FACTS:4 + (i + 1) * _FACTS] = facts[:, at].T
        rows.append(("sum", bucket, -1, None, None, pack(sums.ravel())))
        ids, facts, lang = ids[offset > 1], facts[:, offset > 1], lang[offset > 1]
        firsts = numbering.first.ravel()
        own = np.searchsorted(firsts, ids, side="right") - 1
        heads = np.flatnonzero(np.diff(own, prepend=-1))
        for a, z in zip(heads, np.append(heads[1:], len(ids))):
            rows.append(("word", int(own[a] % numbering.buckets), -2, numbering.langs[lang[a] - 1],
                         pack((ids[a:z] - firsts[own[a]] + 1).astype(np.uint32)), pack(facts[:, a:z].ravel())))
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(
            (pa.string(), pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary()))],
            names=["kind", "bucket", "chunk", "lang", "ranks", "stats"])

    return run


def _total_facts(table: pa.Table) -> pa.Table:
    """A bucket's words' facts, given back to every chunk; chunk -1: by language how many words follow 1, 2, 3, 4 and at
    least 3 distinct words, and how many distinct bigrams these end."""
    rows, langs, chunk = [], np.array(table["lang"].to_pylist(), object), np.array(table["chunk"].to_pylist())
    bucket, place = table["bucket"][0].as_py(), table["place"].to_pylist()
    for lang in sorted(set(langs)):
        at = np.flatnonzero(langs == lang)
        ranks = {int(i): unpack(table["ranks"][int(i)].as_py(), np.uint32) for i in at}
        facts = np.zeros((_FACTS, 1 + max(int(r.max(initial=0)) for r in ranks.values())), np.int64)
        for i in at[chunk[at] == -2]:
            facts[:, ranks[int(i)]] += unpack(table["stats"][int(i)].as_py(), np.int64).reshape(_FACTS, -1)
        rows += [(chunk[i], place[i], lang, pack(ranks[int(i)]), pack(facts[:, ranks[int(i)]].ravel())) for i in at[chunk[at] >= 0]]
        before = facts[0, 1:]
        rows.append((-1, -1, lang, None, pack(np.array([*[(before == c).sum() for c in range(1, 5)], (before >= 3).sum(), before.sum()]))))
    return pa.table([pa.array([bucket] * len(rows), pa.int32()), pa.array([int(r[0]) for r in rows], pa.int64()),
                     pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string()),
                     pa.array([r[3] for r in rows], pa.binary()), pa.array([r[4] for r in rows], pa.binary())],
                    names=["bucket", "chunk", "place", "lang", "ranks", "stats"])


class Sums:
    """What all chunks need to know of a language: discounts, the lower order's sums, its start's and unknown word's facts."""

    def __init__(self, numbering: Numbering, bigrams: np.ndarray, words: np.ndarray):
        self.numbering = numbering
        self.start, self.unknown = bigrams[:, 4:4 + _FACTS], bigrams[:, 4 + _FACTS:]
        own = self.unknown[:, 0]
        n = words[:, :5] + np.stack([own == 1, own == 2, own == 3, own == 4, own >= 3], axis=1)
        self.bigram = np.stack([_discounts(*c) for c in bigrams[:, :4].astype(float)])
        self.word = np.stack([_discounts(*c) for c in n[:, :4].astype(float)])
        self.every = np.maximum(words[:, 5] + own, 1)
        freed = (self.word[:, 1:] * n[:, [0, 1, 4]]).sum(axis=1) / self.every
        self.even = freed / np.maximum(numbering.words + 1, 1)

    def log10(self, found: list, counts: list, codes: np.ndarray, offsets: np.ndarray, buckets: int) -> np.ndarray:
        """Log10 probability of every word of a chunk after the one before it."""
        ids = self.numbering.ids(found)
        if not len(codes):
            return np.empty(0)
        facts = np.concatenate([unpack(x["stats"], np.int64).reshape(_FACTS, -1) for x in found], axis=1)
        lang = self.numbering.language(ids)
        unknown = ids == self.numbering.unknown[lang]
        facts[:, unknown] = self.unknown[lang[unknown]].T
        cut = self.word[lang, np.minimum(facts[0], 3)]
        alone = np.maximum(np.maximum(facts[0] - cut, 0) / self.every[lang] + self.even[lang], 1e-12)
        keys, number, _ = _bigrams(ids, codes, offsets, self.numbering, buckets)
        n = np.concatenate([unpack(x["ranks"], np.uint32) for x in counts]).astype(np.int64)
        first, second = (keys >> np.uint64(32)).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        distinct, at = np.unique(ids, return_index=True)
        begins = first == self.numbering.starts[self.numbering.language(first)]
        slot = at[np.minimum(np.searchsorted(distinct, first), len(distinct) - 1)]
        of = self.numbering.language(first)
        context = np.where(begins, self.start[of].T, facts[:, slot])
        d = self.bigram[of]
        direct = (n - d[np.arange(len(n)), np.minimum(n, 3)]) / context[1]
        rest = np.clip((d[:, 1:].T * context[2:]).sum(axis=0) / context[1], 1e-9, 1)
        log10 = np.log10(direct + rest * alone[at[np.searchsorted(distinct, second)]]).astype(np.float32)
        spread = np.where(unknown, np.log10(self.numbering.spread[lang]), 0).astype(np.float32)
        return log10[number] - spread[codes]


def _score(sent, buckets: int, kinds: list):
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                x = {c: b.column(c)[r].as_py() for c in ("offsets", "codes", "numbers", "failed", "found", "counts")}
                offsets, codes = unpack(x["offsets"], np.int64), unpack(x["codes"], np.uint32).astype(np.int64)
                p = _per_word(sent.value.log10(sorted(x["found"] or [], key=lambda f: f["place"]),
                                               sorted(x["counts"] or [], key=lambda f: f["bucket"]), codes, offsets, buckets), offsets)
                numbers = unpack(x["numbers"], np.int64).reshape(len(_NUMBERS), -1)
                yield pa.RecordBatch.from_arrays(
                    [b.column(c).slice(r, 1).flatten() for c in kinds] + [pa.array(n, pa.int64()) for n in numbers]
                    + [pa.array(unpack(x["failed"], np.uint8).astype(bool)), pa.array(p, pa.float64(), mask=np.isnan(p))],
                    names=[*kinds, *_NUMBERS, "base_failed", "perplexity"])

    return run


def perplexities(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, lang, further columns and the measures of every document row, by the model of all of them."""
    spark, kinds = docs.sparkSession, ["doc_id", "lang", *more]
    rows = docs.select("text", *kinds).withColumn("lang", F.coalesce(F.col("lang").cast("string"), F.lit("")))
    types = {c: rows.schema[c].dataType.simpleString() for c in kinds}
    buckets = shuffle_partitions(spark)
    given, numbered, held, added = (scratch_dir(spark) for _ in range(4))
    split = materialise(rows.mapInArrow(returned(_state(buckets, kinds)), ", ".join(f"{c} array<{t}>" for c, t in types.items()) + f", {_STATE}")
                        .withColumn("chunk", F.monotonically_increasing_id()), given)
    words = materialise(split.select("chunk", F.inline("sent")).groupBy("bucket").applyInArrow(_number_words, _WORDS), numbered)
    state = materialise_buckets(split.drop("sent"), "chunk", buckets, held)
    discard(spark, given)
    numbering = Numbering({(r["lang"], r["bucket"]): tuple(unpack(r["ranks"], np.int64).tolist())
                           for r in words.where("chunk = -1").collect()}, buckets)
    words, sent = words.where("chunk >= 0"), spark.sparkContext.broadcast(numbering)
    answers = words.groupBy("chunk").agg(F.collect_list(F.struct("place", "bucket", "lang", "ranks")).alias("found"))
    pairs = max(buckets, (state.agg(F.sum("n_words")).first()[0] or 0) // BUCKET)
    for share in range(PASSES):
        part = (state.select("chunk", "offsets", "codes").join(answers, "chunk")
                .mapInArrow(returned(_send_bigrams(sent, pairs, share)), "bucket int, chunk long, keys binary, ns binary")
                .groupBy("bucket").applyInArrow(_total_bigrams(sent), _BIGRAMS))
        with freed(spark):
            part.write.partitionBy("kind").mode("append").parquet(added)
    bigrams = spark.read.schema(part.schema).parquet(added)
    asked = words.withColumn("stats", F.lit(None).cast("binary"))
    adding = bigrams.where("kind = 'word'").select("bucket", "chunk", F.lit(-1).alias("place"), "lang", "ranks", "stats")
    facts = materialise(asked.unionByName(adding).groupBy("bucket").applyInArrow(_total_facts, f"{_WORDS}, stats binary"))
    # The answers hold the words' numbers too, and what was added is in them.
    for path in (numbered, f"{added}/kind=word"):
        discard(spark, path)
    shape = (len(numbering.starts), 4 + 2 * _FACTS)
    by_lang, ends = np.zeros(shape, np.int64), np.zeros((shape[0], 6), np.int64)
    for r in bigrams.where("kind = 'sum'").select("stats").toLocalIterator():
        by_lang += unpack(r["stats"], np.int64).reshape(shape)
    for r in facts.where("chunk = -1").select("lang", "stats").toLocalIterator():
        ends[numbering.at[r["lang"]]] += unpack(r["stats"], np.int64)
    found = facts.where("chunk >= 0").groupBy("chunk").agg(F.collect_list(F.struct("place", "bucket", "lang", "ranks", "stats")).alias("found"))
    counts = bigrams.where("kind = 'n'").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "ranks")).alias("counts"))
    return state.drop("n_words").join(found, "chunk", "left").join(counts, "chunk", "left").drop("chunk").mapInArrow(
        returned(_score(spark.sparkContext.broadcast(Sums(numbering, by_lang, ends)), pairs, kinds)),
        ", ".join(f"{c} {t}" for c, t in types.items()) + ", " + ", ".join(f"{c} long" for c in _NUMBERS)
        + ", base_failed boolean, perplexity double")


def bands(measured: DataFrame, width: float = WIDTH, low: float = LOW_SHARE) -> DataFrame:
    """lang, lower, upper from all documents that pass the base rules."""
    q = F.percentile_approx("perplexity", [0.25, 0.5, 0.75], 10000)
    return measured.where("NOT base_failed").groupBy("lang").agg(q.alias("q")).select(
        "lang", (low * F.col("q")[1]).alias("lower"),
        (F.col("q")[1] + width * (F.col("q")[2] - F.col("q")[0]) / 1.349).alias("upper"))


def _kept(measured: DataFrame) -> DataFrame:
    """The measured rows and ``kept``."""
    inside = F.coalesce((F.col("perplexity") >= F.col("lower")) & (F.col("perplexity") <= F.col("upper")), F.lit(True))
    # A language may hold most rows: its band is repeated under SALTS keys and the rows are dealt over them.
    measured = measured.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "perplexity"), F.lit(SALTS)))
    limits = bands(measured).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)).cast("array<bigint>")))
    return measured.join(limits, ["lang", "salt"], "left").withColumn("kept", ~F.col("base_failed") & inside)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = materialise(perplexities(read(spark, sf_dir, "documents")))
    return _kept(measured).select("doc_id", *_NUMBERS, "base_failed", "kept", "perplexity")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the document rows that pass base rules and perplexity band, all columns kept."""
    # A row's verdict depends on language and text; the id spreads copies. Two hashes tell rows apart.
    given = [F.col("doc_id").cast("string"), F.coalesce(F.col("lang").cast("string"), F.lit("")), F.col("text")]
    marks = {"_mark": F.xxhash64(*given), "_mark2": F.xxhash64(F.lit(2), *given)}
    marked = docs.withColumns(marks)
    good = _kept(materialise(perplexities(marked, *marks))).where("kept").select(*marks).distinct()
    return marked.join(good, list(marks), "left_semi").select(*docs.columns)
