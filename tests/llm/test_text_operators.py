"""Decontamination, quality, personal data, pages, pieces, training order and scores against brute force."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dealscreen.llm import common, decontaminate, html, mixing, pieces, pii, quality, training_order
from dealscreen.llm.common import coded, scratch_dir, split_words


def test_split_words(texts):
    sample = [t for _, t in texts] + ["a\x0bb\x0cc\rd", "\x1c e\x85f\xa0g"]
    words, offsets = split_words(pa.array(sample, pa.string()))
    for i, t in enumerate(sample):
        assert words.to_pylist()[offsets[i]:offsets[i + 1]] == re.findall(r"[^\x20\x09-\x0D]+", t or "")


# -- decontamination

def contaminated(texts, items):
    word = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
    out = []
    for d, t in texts:
        w, hit, found = word(t), set(), set()
        for i, x in items:
            x = word(x)
            n = min(10, len(x))
            windows = {tuple(x[s:s + n]) for s in range(len(x) - n + 1)} if n else set()
            for s in range(len(w) - n + 1) if n else ():
                if tuple(w[s:s + n]) in windows:
                    hit.update(range(s, s + n))
                    found |= {str(i)} - {"None"}
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontaminate(spark, docs, texts, block_bytes):
    t = dict(texts)
    items = [(1, t[1].upper()), (2, " ".join(t[5].split()[:12])), (3, "one, TWO"), (4, None), (5, ""), (11, t[103][-120:]),
             (None, t[9]), (3, "a " * 30), (7, "中文"), (2, "w1x w2x w3x w4x w5x w6x w7x w8x w9x")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.contaminated_words(docs, bench, block_bytes=block_bytes))
    assert Counter(tuple(r) for r in got.collect()) == Counter(contaminated(texts, items))


def test_decontaminate_empty(spark, docs, no_docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated_words(no_docs, none).count() == 0
    assert decontaminate.digest(decontaminate.contaminated_words(docs, none)).where("contaminated").count() == 0


# -- quality

def base_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    covered = {i + j for i in range(len(w) - 2) if seen[tuple(w[i:i + 3])] > 1 for j in range(3)}
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered),
            len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_quality_base(spark, docs, texts):
    texts = dict(texts[:-4]) | {200: "a b c\n#x|\na b c\n \na b c <&>"}
    df = spark.createDataFrame([(i, t, "en") for i, t in texts.items()], "doc_id long, text string, lang string")
    model = spark.sparkContext.broadcast(quality.train(df))
    for r in quality.scored(df, model).collect():
        assert (*(r[c] for c in quality._NUMBERS), r.base_failed) == base_counts(texts[r.doc_id])
        assert (r.perplexity is None) == (r.n_words == 0)


def test_quality_model_sums_to_one(docs):
    model = quality.train(docs)
    voc = model.vocabulary
    for before in (quality.START, 1, 2, voc.size - 1):
        ids = np.arange(1, voc.size)
        flat = np.stack([np.full(len(ids), before), ids], axis=1).ravel()
        # Each pair is a text of its own; its second word's probability follows the first.
        logs = model.log10(flat, np.arange(0, len(flat) + 1, 2))[1::2] if before else model.log10(ids, np.arange(len(ids) + 1))
        # An unknown word's share is spread over the words it stands for.
        assert math.isclose((10 ** (logs + model.unknown[ids])).sum(), 1, rel_tol=1e-3)


def test_quality_rejects_noise_and_keeps_clean(spark):
    sf_dir = "/root/testdata/sf0.01"  # enough text for a model
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = docs.where("lang = 'en' AND n_chars > 1500").first()["text"]
    rng = np.random.default_rng(1)
    noise = " ".join("".join(chr(c) for c in rng.integers(33, 0x2FF, 9)) for _ in range(300))
    more = spark.createDataFrame([(900001, noise, "en"), (900002, text, "en")], "doc_id long, text string, lang string")
    kept = quality.keep_good(spark, docs.select("doc_id", "text", "lang").union(more), sf_dir)
    assert kept.columns == ["doc_id", "text", "lang"]
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    assert 900001 not in ids and 900002 in ids


def test_quality_of_a_language_is_its_own(spark):
    """How much text of another language there is changes no perplexity, and a rare language has known words."""
    rng = np.random.default_rng(2)
    rare = [(i, " ".join(f"r{x % 400}" for x in rng.zipf(1.4, 120)), "xx") for i in range(20)]
    other = [(100 + i, " ".join(f"o{x}" for x in rng.integers(0, 3000, 20000)), "en") for i in range(20)]

    def perplexities(rows):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        model = quality.train(df)
        assert len(model.vocabulary.words["xx"][0]) > 50
        out = quality.scored(df, spark.sparkContext.broadcast(model)).where("lang = 'xx'").collect()
        return {r.doc_id: round(r.perplexity, 4) for r in out}

    assert perplexities(rare) == perplexities(rare + other)


def test_quality_counts_rare_words_and_bigrams_of_a_large_language(spark):
    """However much text a language has, a word found twice is known and a bigram found once counts."""
    rng = np.random.default_rng(3)
    large = [(i, " ".join(f"o{x}" for x in rng.integers(0, 40, 160000)), "en") for i in range(14)]
    rare = [(100 + i, " ".join(f"r{x}" for x in range(60)), "en") for i in range(2)] + [(102, "r3 r9 r5 o1 o2", "en"), (103, None, None)]
    df = spark.createDataFrame(large + rare, "doc_id long, text string, lang string").repartition(5)
    model = quality.train(df)
    assert {f"r{x}" for x in range(60)} <= set(model.vocabulary.words["en"][0].to_pylist())
    got = {r.doc_id: r for r in quality.perplexities(df).collect()}
    # The two texts' bigrams occur in them alone: each word is nearly certain after the one before it.
    assert got[100].perplexity == got[101].perplexity < 0.5 < got[102].perplexity
    # The model's parts in their buckets score like the whole one.
    assert got == {r.doc_id: r for r in quality.scored(df, spark.sparkContext.broadcast(model)).collect()}


def test_quality_empty(spark, no_docs):
    assert quality.keep_good(spark, no_docs, "").count() == 0


# -- personal data

def test_pii_formats_links_and_validity(spark):
    card, iban, mail = "4111111111111111", "DE89370400440532013000", "ann.lee7@mail.example.com"
    rows = [(1, f"pay {card} or 4111 1111 1111 1111, not 4111111111111112; {iban}; {mail}!"),
            (2, f"{mail} {card} 123-45-6789 000-12-3456 1990-05-13 13/05/1990 1990-02-30"),
            (3, "+1 (504) 555-2652 190.137.223.204 and 1.2.3 or 300.1.1.1"), (4, None), (5, ""), (6, "plain text, 3 of 4."),
            (7, 'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde"'), (7, mail)]
    out = [(r.row.doc_id, r.new, r.replaced) for r in pii.pseudonymise(
        spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    new = defaultdict(list)
    for i, t, n in out:
        new[i].append((t, n))
    one, two, three = new[1][0][0], new[2][0][0], new[3][0][0]
    luhn = lambda s: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0
    made = re.search(r"pay (\d{16}) or (\d{4} \d{4} \d{4} \d{4}), not 4111111111111112; (DE\d{20}); (\S+)!", one)
    assert made and luhn(made[1]) and made[1] != card and made[2].replace(" ", "") == made[1]
    assert int("".join(str(int(c, 36)) for c in made[3][4:] + made[3][:4])) % 97 == 1 and made[3] != iban
    assert made[4] != mail and made[4].endswith("@mail.example.com") and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\d", made[4].split("@")[0])
    assert two.startswith(f"{made[4]} {made[1]} ") and new[7][0 if "@" in new[7][0][0] else 1][0] == made[4]
    assert re.search(r" \d{3}-\d{2}-\d{4} 000-12-3456 \d{4}-\d{2}-\d{2} \d{2}/\d{2}/\d{4} 1990-02-30$", two)
    assert "123-45-6789" not in two and "1990-05-13" not in two
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} \d+\.\d+\.\d+\.\d+ and 1\.2\.3 or 300\.1\.1\.1", three)
    assert "555-2652" not in three and "190.137" not in three
    assert new[4] == [(None, 0)] and new[5] == [("", 0)] and new[6] == [("plain text, 3 of 4.", 0)]


def test_pii_permutations_are_one_to_one(spark):
    df = spark.range(20000).selectExpr(
        f"{pii.permuted_number('id', 100, 200, 't', 'k')} AS n", f"{pii.permuted_text('lpad(id, 5, 0)', 't', 'k')} AS t",
        "date_format(date_add(DATE'1990-01-01', CAST(id AS INT)), 'yyyy-MM-dd') AS d").selectExpr(
        "n", "t", f"{pii.pseudonym('d')} AS d")
    n = df.selectExpr("count(DISTINCT n)", "count(DISTINCT t)", "count(DISTINCT d)", "min(n)", "max(n)").first()
    assert tuple(n) == (20000, 20000, 20000, 0, 19999)


def test_pii_long_matches(spark):
    """Runs of 100 kB that look like every shape: no shape recurses over its match, and an empty table has no rows."""
    n = 100_000
    runs = ["a@" + "b." * (n // 2) + "com", "a@" + "b" * n + ".com", "a." * (n // 2) + "@b.com", "GB82" + " WEST" * (n // 5),
            "1" * n, "0123456789abcdef" * (n // 16), "+1" + " 23" * (n // 3), "1." * (n // 2) + "1", "2020-01-01-" * (n // 11),
            "4111 " * (n // 5), "(555) " * (n // 6), "a@b" * (n // 3)]
    docs = spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")
    out = {r.row.doc_id: r.new for r in pii.pseudonymise(docs).collect()}
    assert len(out) == len(runs) and all(len(out[i]) == len(t) for i, t in enumerate(runs))
    assert out[0].endswith("@" + "b." * (n // 2) + "com") and out[0][0] != "@"
    assert pii.pseudonymise(docs.limit(0)).count() == 0


def test_pii_key_of_the_session(spark):
    """The session's key makes other pseudonyms than the public one, the same as when it is given; empty tables stay empty."""
    docs = spark.createDataFrame([(1, "ask jane.doe@mail.example or 4111 1111 1111 1111"), (2, None), (3, "")], "doc_id long, text string")

    def made(**options):
        return {r.row.doc_id: r.new for r in pii.pseudonymise(docs, **options).collect()}

    public = made()
    spark.conf.set(pii.KEY_SETTING, "own 'key\\")
    try:
        own = made()
        assert pii.pseudonymise(docs.where("doc_id > 9")).count() == 0
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert own == made(key="own 'key\\") and own[1] != public[1] == made(key=pii.KEY)[1] and (own[2], own[3]) == (None, "")


def test_pii_stage(spark, docs):
    out = pii.replace_private(spark, docs, "")
    assert out.dtypes == docs.dtypes and out.count() == docs.count()


# -- pages

def test_pages_by_markup(spark):
    page = ("<html><head><title>t</title><script>var a='</p><p>no';</script></head><body><nav><a>menu</a></nav>"
            "<div class='ad-box ad'>buy</div><article><h1>Head &amp; more</h1><p>one<b>two</b>&nbsp; three<br>four<p>next"
            "<aside>side</aside><form>f</form><section id=comments><p>remark</p></section></article><footer>foot</footer>")
    rows = [(1, "http://a.example/x", page), (1, "http://a.example/x", page), (2, None, None), (3, "", ""),
            (4, "http://[bad", "plain <b>text"), (None, "http://b.example", "<p>x<p>y</div><!-- c --><p>z &lt;"),
            (5, "http://b.example", "<main><p>m</p></main><p>out</p>"), (6, "u", "<p>cut <a hre")]
    got = Counter((r.row.page_id, r.text) for r in html.main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    assert got == Counter({(1, "Head & more\nonetwo three four\nnext"): 2, (2, ""): 1, (3, ""): 1, (4, "plain text"): 1,
                           (None, "x\ny\nz <"): 1, (5, "m"): 1, (6, "cut"): 1})


def test_pages_style_tree(spark):
    """Without marked articles, what a host's pages share is removed; a host with few pages keeps everything."""
    page = "<body><div class=x><span>About us</span></div><div class=y><p>Text {0} of page</p><p>Ends {0}</p></div><div class=z><p>All rights</p></div>"
    rows = [(i, f"http://many.example/{i}", page.format(i)) for i in range(30)]
    rows += [(100 + i, f"http://few.example/{i}", page.format(i)) for i in range(2)]
    got = {r.row.page_id: r.text for r in html.main_text(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5] == "Text 5 of page\nEnds 5" and got[100] == "About us\nText 0 of page\nEnds 0\nAll rights"


def texts_of(spark, rows, **options):
    schema = "page_id long, url string, html string, row string, blocks string, uid string, main string"
    rows = [(*r, "r", "b", "u", "m") for r in rows]
    return {r.row.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, schema).repartition(4), **options).collect()}


def test_pages_repeated_advert_in_articles(spark):
    """Inside marked articles the entropy decides: a line of all articles goes; a passage that many quote, and an article
    copied to many addresses of two hosts, stay whole."""
    quote = "<p>A passage that many articles quote</p>"
    page = "<body><article><h1>Title {0}</h1><p>Own text {0}</p>{1}<p>Buy our things now</p></article></body>"
    rows = [(i, f"http://h.example/{i}", page.format(i, quote if i % 2 else "")) for i in range(40)]
    copied = "<body><article><h1>Wire story</h1><p>Copied text</p></article></body>"
    rows += [(100 + i, f"http://{'h' if i % 2 else 'g'}.example/wire/{i}", copied) for i in range(60)]
    got = texts_of(spark, rows)
    assert got[0] == "Title 0\nOwn text 0" and got[1] == "Title 1\nOwn text 1\nA passage that many articles quote"
    assert {got[100 + i] for i in range(60)} == {"Wire story\nCopied text"}


def test_pages_mixed_host(spark):
    """Pages with and without a marked article are one tree: what nearly all share goes where nothing is marked."""
    shared = "<div class=z><p>All rights of the site</p></div>"
    rows = [(i, f"http://h.example/{i}", f"<body><article><p>Marked text {i}</p></article>{shared}</body>") for i in range(50)]
    rows += [(50 + i, f"http://h.example/{50 + i}", f"<body><div class=y><p>Open text {i}</p></div>{shared}</body>") for i in range(3)]
    got = texts_of(spark, rows)
    assert got == {i: f"Marked text {i}" for i in range(50)} | {50 + i: f"Open text {i}" for i in range(3)}


def test_pages_teaser_and_hints(spark):
    """An article with little of the text marks nothing; in an article a class name alone rules no real text out."""
    teaser = "<body><article><p>Teaser</p></article><div class=story><p>{}</p></div></body>".format("The long story. " * 9)
    hints = ("<article><p>Text</p><div class='related-work'><p>Earlier work found this</p></div><p class=notice>Note the scale</p>"
             "<div class=related><a href=1>Other page</a></div><div class=ad>Buy</div><div class=comments>Me too</div></article>")
    rows = [(1, "http://a.example", teaser), (2, "http://a.example", hints)]
    rows += [(10 + i, f"http://n.example/{i}", f"<article><p>Text number {i}</p>{'<p class=notice>Beta site</p>' if i < 3 else ''}</article>")
             for i in range(30)]
    got = texts_of(spark, rows)
    assert got[1] == "Teaser\n" + ("The long story. " * 9).strip() and got[2] == "Text\nEarlier work found this\nNote the scale"
    assert {got[10 + i] for i in range(30)} == {f"Text number {i}" for i in range(30)}


def test_pages_importances(spark):
    """Entropies of a small site against a restatement in Python, counted over pages with different main parts."""
    rng = np.random.default_rng(3)
    pages = [f"<body><div class=x><p>{'abcd'[rng.integers(4)]}</p></div><div class=y><p>{'same' if rng.integers(9) else 'rare'}</p>"
             f"{'<p>more</p>' if rng.integers(2) else ''}</div><p>{rng.integers(25)}</p></body>" for _ in range(80)]
    rows = [(i, f"http://s.example/{i}", x) for i, x in enumerate(pages)]
    tree = html.parsed(spark.createDataFrame(rows, "page_id long, url string, html string")).withColumn(
        "uid", F.col("row.page_id")).cache()
    contents, branches = html.importances(tree, 0.5)
    apart = {}
    for source in pages:
        found, _, shapes, _ = html.page_blocks(source)
        apart[tuple(b.text for b in found)] = (found, shapes)
    m, texts, styles, below = Counter(), Counter(), defaultdict(Counter), defaultdict(list)
    for found, shapes in apart.values():
        shapes.pop("")
        m.update(list(shapes))
        for p, s in shapes.items():
            styles[p][tuple(s)] += 1
        texts.update({(b.path, b.text) for b in found})
    importance = {(p, t): 1 - math.log(c) / math.log(m[p]) if m[p] >= html.MIN_PAGES else 1 for (p, t), c in texts.items()}
    for (p, t), c in texts.items():
        for q in m:
            if p == q or p.startswith(q + "/"):
                below[q] += [importance[p, t]] * c
    branch = {p: 0.1 * -sum(c / m[p] * math.log(c / m[p]) for c in styles[p].values()) / math.log(m[p])
              + 0.9 * sum(below[p]) / len(below[p]) for p in m if below[p] and m[p] >= html.MIN_PAGES}
    key = lambda *x: html._key("s.example", *x)
    got = {(r["key"], r["hash"]): r["importance"] for r in contents.collect() if r["importance"] < 0.5}
    assert got == pytest.approx({(key(p), html._key(t)): i for (p, t), i in importance.items() if i < 0.5}) and got
    least = {p: min(branch[q] for q in branch if p == q or p.startswith(q + "/")) for p, _ in texts}
    assert {r["key"]: r["importance"] for r in branches.collect()} == pytest.approx({key(p): x for p, x in least.items() if x < 0.5})


def test_pages_long(spark):
    """A page of some megabytes and deep markup come back whole."""
    long = "<article>" + "<p>word &amp; more </p>" * 200_000 + "</article>"
    deep = "<div>" * 400 + "deep text" + "</div>" * 400
    got = texts_of(spark, [(1, "http://a.example", long), (2, None, deep)])
    assert got[1] == "\n".join(["word & more"] * 200_000) and got[2] == "deep text"


def test_pages_empty(spark):
    assert html.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# -- pieces

VOCABULARY = pieces.pieces(pieces.MODEL)


def segmentations(text):
    """All segmentations of a short text with their probabilities."""
    by = defaultdict(list)
    for i, s in enumerate(VOCABULARY.surface.to_pylist()):
        if s and i not in set(VOCABULARY.byte_ids.tolist()):
            by[s].append(i)

    def walk(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            for i in by.get(rest[:n].encode(), ()):
                for tail, p in walk(rest[n:]):
                    yield (i, *tail), p + VOCABULARY.logp[i]

    found = dict(walk(" " + text))
    total = np.logaddexp.reduce(list(found.values()))
    return {k: math.exp(v - total) for k, v in found.items()}


def test_pieces_distribution():
    text, n = "ab", 6000
    want = segmentations(text)
    made = pieces.sample(pa.array([text] * n), np.arange(n, dtype=np.uint64) * np.uint64(977), 3, VOCABULARY)
    for s in made:
        assert len({tuple(i.tolist()) for i, _, _ in s}) == len(s) == min(3, len(want))
        assert all(math.isclose(p, math.log(want[tuple(i.tolist())]), abs_tol=1e-6) for i, p, _ in s)
    # Without replacement: the chance of each ordered pair follows from the probabilities.
    first = Counter(tuple(s[0][0].tolist()) for s in made)
    second = Counter((tuple(s[0][0].tolist()), tuple(s[1][0].tolist())) for s in made)
    for k, p in want.items():
        assert abs(first[k] / n - p) < 4 * math.sqrt(p * (1 - p) / n) + 1e-3
        for m, q in want.items():
            if m != k:
                both = p * q / (1 - p)
                assert abs(second[k, m] / n - both) < 4 * math.sqrt(both * (1 - min(both, 1)) / n) + 2e-3
    # Inclusion scores are unbiased weights.
    assert abs(np.mean([sum(math.exp(p) / q for _, p, q in s) for s in made]) - 1) < 0.02


def test_pieces_round_trip(spark, docs, texts):
    got = defaultdict(list)
    for r in pieces.sampled(docs.limit(1000), k=3).collect():
        t = r.row.text or ""
        assert len({tuple(s.ids) for s in r.samples}) == len(r.samples) >= 1
        assert all(pieces.decode(s.ids, VOCABULARY) == t and 0 <= s.inclusion <= 1 for s in r.samples)
        got[r.row.doc_id, r.row.text].append([tuple(s.ids) for s in r.samples])
    assert all(x == v[0] for v in got.values() for x in v)
    again = pieces.sampled(docs.repartition(1), k=3).collect()
    assert all([tuple(s.ids) for s in r.samples] == got[r.row.doc_id, r.row.text][0] for r in again)


def test_pieces_empty(no_docs):
    assert pieces.sampled(no_docs).count() == 0 and pieces.sampled(no_docs, digest=True).count() == 0


# -- training order

def test_order_is_a_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        order = training_order.Order(n)
        slots = order.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (order.numbers(slots) == np.arange(n)).all()


def test_training_order_round_trip(spark, docs, texts):
    uri = scratch_dir(spark) + "/shards"
    uri = uri if ":/" in uri else f"file://{uri}"
    out = training_order.training_order(docs, uri, seq_len=64, shard=50).collect()
    assert sorted(r.slot for r in out) == list(range(len(out)))
    records = training_order.read_records(uri, 0, len(out), shard=50, seq_len=64)
    enc = training_order.encoding(training_order.RANKS)
    # Put the streams together again: by document, each id at its place.
    got, want = Counter(), Counter()
    by_slot = {r.slot: r for r in out}
    held = defaultdict(list)
    for slot, (doc, offset, ids) in enumerate(records):
        r = by_slot[slot]
        assert (r.shard, r.byte_offset) == (slot // 50, slot % 50 * (16 + 128)) and r.doc_ids[0] == doc and r.offset == offset
        place, at = offset, 0
        for x in ids.tolist():
            held[r.doc_ids[at]].append((place, x))
            place += 1
            if x == training_order.END:
                at, place = at + 1, 0
        assert at in (len(r.doc_ids), len(r.doc_ids) - 1)
    for doc, ids in held.items():
        got.update((doc, *i) for i in ids)
    for d, t in texts:
        if t is not None:
            want.update((-1 if d is None else d, *i) for i in enumerate([*enc.encode_ordinary(t), training_order.END]))
    assert got == want
    assert [x[:2] for x in training_order.read_records(uri, 47, 9, shard=50, seq_len=64)] == [x[:2] for x in records[47:56]]


def test_training_order_follows_from_documents_alone(spark, docs, texts, monkeypatch):
    """The same shards from 1 and 7 input splits, from other ranges and with small batches; the stream is that of the
    documents sorted by id and hash, and sequences that lie in several batches are whole."""
    enc = training_order.encoding(training_order.RANKS)
    found = []
    for splits, ranges, size in ((1, 8, 16 << 20), (7, 3, 100), (4, 1, 5000)):
        monkeypatch.setattr(training_order, "PLACE_BYTES", size)
        monkeypatch.setattr(training_order, "shuffle_partitions", lambda _: ranges)
        out = training_order.training_order(docs.repartition(splits), scratch_dir(spark) + "/shards", seq_len=64, shard=50)
        found.append(sorted(map(tuple, out.collect())))
    assert found[0] == found[1] == found[2]
    hashed = docs.selectExpr("coalesce(doc_id, -1) AS doc_id", "xxhash64(text) AS hash", "text").where("text IS NOT NULL")
    stream = [x for r in sorted(map(tuple, hashed.collect())) for x in (*enc.encode_ordinary(r[2]), training_order.END)]
    order = training_order.Order(-(-len(stream) // 64))
    want = [stream[n * 64:n * 64 + 64] for n in order.numbers(np.arange(order.n)).astype(int).tolist()]
    assert [r[6] for r in found[0]] == [hashlib.sha256(np.array(w, "<u2").tobytes()).hexdigest() for w in want]


def test_training_order_ranges(spark, docs, monkeypatch):
    """Each task of the last exchange has a range of shards, also where there are fewer tasks than shards."""
    monkeypatch.setattr(training_order, "shuffle_partitions", lambda _: 3)
    out = training_order.training_order(docs, scratch_dir(spark) + "/shards", seq_len=16, shard=8)
    spans = sorted(out.groupBy(F.col("_metadata.file_name")).agg(F.min("shard"), F.max("shard")).select(
        "min(shard)", "max(shard)").collect())
    assert len(spans) > 1 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_training_order_hot_id(spark):
    """A third of all rows is one document: its copies are dealt over the ranges, and each is encoded."""
    rows = [(i if i % 3 else 7, f"text {i if i % 3 else 7}") for i in range(300)]
    hot = spark.createDataFrame(rows, "doc_id long, text string")
    held = training_order.encoded(hot).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in held) < 100
    out = training_order.training_order(hot, scratch_dir(spark) + "/shards", seq_len=16, shard=8)
    assert sum(r.n_ids for r in out.collect()) == sum(
        len(training_order.encoding(training_order.RANKS).encode_ordinary(t)) + 1 for _, t in rows)


def test_training_order_empty(no_docs, spark):
    assert training_order.training_order(no_docs, scratch_dir(spark)).count() == 0


# -- memory of workers, lookup of pieces

def test_base_counts_do_not_depend_on_parts(monkeypatch, texts):
    """Base counts of a chunk are taken of some words at a time; a text is never cut."""
    given = pa.array([t for _, t in texts], pa.string())
    words, offsets = split_words(given)
    codes, _ = coded(words)
    whole = quality._base_part(given, words, codes, offsets)
    seen, part = [], quality._base_part
    monkeypatch.setattr(quality, "_base_part", lambda t, *x: (seen.append(len(x[0])), part(t, *x))[1])
    monkeypatch.setattr(quality, "BASE_WORDS", 500)
    found = quality._base(given, words, codes, offsets)
    assert all(found[c].tolist() == whole[c].tolist() for c in whole)
    assert len(seen) > 5 and sum(seen) == len(words) and sorted(seen)[-2] <= 6000


def test_workers_give_memory_back(monkeypatch):
    """Every batch comes through, and free memory goes back once the task has ended."""
    done = []
    monkeypatch.setattr(common, "give_back", lambda: done.append(1))
    out = common.returned(lambda batches: (b * 2 for b in batches))(iter([1, 2, 3]))
    assert next(out) == 2 and not done
    assert list(out) == [4, 6] and done == [1]


def test_piece_lookup():
    """Every piece and every beginning of one is found by its hash, and nothing else."""
    vocabulary = pieces.pieces(pieces.MODEL)
    assert vocabulary.deepest < 16
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {}
    for i in range(0, vocabulary.size, 7):
        if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
            h = 0
            for c in sp.id_to_piece(i):
                h = (h * int(pieces._MUL) + ord(c) + 1) % 2**64
            want[h] = i
    hit, ids = vocabulary.find(np.array(list(want), np.uint64))
    assert hit.all() and ids.tolist() == list(want.values())
    hit, ids = vocabulary.find(np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    assert not hit.any() and (ids == -1).all()


# -- scores

def test_scores_counts_and_base(spark, docs, texts):
    split = [(d, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) + [None]) for d, t in texts]
    train = Counter(w for d, x in split if not mixing.held_out(d) for w in x)
    n, v = sum(train.values()), len(train)
    want = Counter()
    for d, x in split:
        want[d, mixing.held_out(d), len(x), sum(train[w] > 0 for w in x), n,
             round(sum(math.log10((train[w] + 1) / (n + v + 1)) for w in x), 6)] += 1
    out = mixing.scores(docs).collect()
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    # A repeated text is far more likely than noise of the same length.
    by = {r.doc_id: r.score / r.n_tokens for r in out}
    assert by[111] > by[110]


def test_scores_are_a_code(texts):
    """The chances of all possible next bits sum to one: scoring a text with any last bit flipped gives the rest."""
    words = mixing.Words(np.array([mixing.END], np.uint64), np.array([3]), 5, np.ones(256, np.int64))
    model = mixing.Model([], words)
    bit, _, tree, slots = mixing.bits(mixing.Tokens(pa.array(["abc de"])), words)
    x, gate = model.inputs(tree, slots)

    def chance(b):
        return 2 ** mixing.learn(x, gate, b, tree, model.weights.copy(), model.map.copy())

    before = 2 ** mixing.learn(x[:, :-1], gate[:-1], bit[:-1], tree[:-1], model.weights.copy(), model.map.copy())
    flipped = bit.copy()
    flipped[-1] ^= 1
    assert math.isclose(chance(bit) + chance(flipped), before, rel_tol=1e-4)


@pytest.mark.parametrize("hot", [2, 1 << 18])
def test_scores_count_every_context(monkeypatch, hot):
    """Node counts of all words and bytes below all contexts, also where a context is dealt out by pieces of the code."""
    monkeypatch.setattr(mixing, "HOT", hot)
    rng = np.random.default_rng(3)
    texts = pa.array([" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 3000) if x < 9000) for _ in range(4)] + ["", None, "w1"])
    t = mixing.Tokens(texts)
    distinct, n = np.unique(t.hash, return_counts=True)
    words = mixing.Words(distinct, n, int((n == 1).sum()), np.ones(256, np.int64))
    symbols, key, code, firsts, number, _ = mixing._events([(0, len(texts), t)], words)
    depth, start, counts = mixing._paths(key, code, np.bincount(number))
    s = symbols[0]
    bit, _, _, seen = mixing.expand(s, 0, len(s.code), firsts[0], number, depth, start, counts)
    paths = [format(c, "064b")[:k] for c, k in zip(s.code.tolist(), s.length.tolist())]
    for i in range(3):
        context = s.context[i].tolist()
        nodes = Counter((c, p[:j]) for c, p in zip(context, paths) for j in range(len(p) + 1))
        want = [(nodes[c, p[:j]], nodes[c, p[:j + 1]]) for c, p in zip(context, paths) for j in range(len(p))]
        assert seen[i].T.tolist() == [list(w) for w in want]
    assert "".join(map(str, bit)) == "".join(paths)


def test_scores_give_every_node_once():
    """A bucket gives a chunk the count of each node of its paths once; the chunk has the whole paths of all chunks' events."""
    rng = np.random.default_rng(6)
    keys, codes = rng.integers(0, 2**63, 30).astype(np.uint64), rng.integers(0, 2**14, 500).astype(np.uint64) << np.uint64(50)
    drawn = [(keys[rng.zipf(1.4, 4000) % 30], codes[rng.integers(0, 500, 4000)]) for _ in range(3)]
    events, rows = [mixing._distinct(k, c)[:2] for k, c in drawn], []
    for chunk, (key, code) in enumerate(events):
        heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        rows.append({"bucket": 0, "chunk": chunk, "h": common.pack(np.diff(key[heads], prepend=np.uint64(0))),
                     "size": common.pack(np.diff(np.append(heads, len(key))).astype(np.uint32)), "code": common.pack(code),
                     "n": common.pack(np.ones(len(key), np.uint32))})
    total = Counter((k, c) for key, code in events for k, c in zip(key.tolist(), code.tolist()))
    nodes = Counter()
    for (k, c), n in total.items():
        nodes.update({(k, format(c, "064b")[:j]): n for j in range(65)})
    members = Counter((k, format(c, "064b")[:j]) for k, c in total for j in range(65))
    for (key, code), row in zip(events, mixing._total_events(pa.Table.from_pylist(rows)).to_pylist()):
        depth, start, counts = mixing._given([row], key, code)
        paths = [[(k, format(c, "064b")[:j]) for j in range(d + 1)] for k, c, d in zip(key.tolist(), code.tolist(), depth.tolist())]
        assert all(members[p[-1]] == 1 and all(members[x] > 1 for x in p[:-1]) for p in paths)
        assert [counts[a:a + d + 1].tolist() for a, d in zip(start, depth)] == [[nodes[x] for x in p] for p in paths]
        assert len(common.unpack(row["counts"], np.uint32)) == len({x for p in paths for x in p})


def test_scores_sort_equal_upper_bits():
    """Keys and codes that differ in their lowest bits alone are told apart and sorted."""
    rng = np.random.default_rng(8)
    key = (np.uint64(7) << np.uint64(40)) + rng.integers(0, 9, 5000).astype(np.uint64)
    code = (np.uint64(5) << np.uint64(60)) + rng.integers(0, 9, 5000).astype(np.uint64)
    k, c, number = mixing._distinct(key, code)
    assert list(zip(k.tolist(), c.tolist())) == sorted(set(zip(key.tolist(), code.tolist())))
    assert (k[number] == key).all() and (c[number] == code).all()


def test_scores_know_the_word_before_a_rare_word(spark):
    """A word that is not among the most frequent ones is a context like every other."""
    rng = np.random.default_rng(5)
    line = lambda order: " ".join(f"a{i} b{i}" for i in order)
    common = " ".join(f"c{i} " * 9 for i in range(4200))  # more words that are more frequent
    train = [i for i in range(400) if not mixing.held_out(i)]
    held = next(i for i in range(400) if mixing.held_out(i))
    rows = [(train[i], line(rng.permutation(2000))) for i in range(4)] + [(train[4], common)]
    alone = next(i for i in range(held + 1, 400) if mixing.held_out(i))
    order = rng.permutation(2000)
    rows += [(held, line(order)), (alone, " ".join(f"a{i} b{j}" for i, j in zip(order, rng.permutation(2000))))]
    by = {r.doc_id: r.score for r in mixing.scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert by[held] > 0.75 * by[alone]


def test_scores_fit_on_every_training_document(spark, monkeypatch):
    """The fit counts every bit of all training rows, without the row's own counts, however the rows are dealt."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, 30) if x < 900)) for i in range(300)] + [(None, "w1 w2"), (5, None)]
    docs, held = spark.createDataFrame(rows, "doc_id long, text string"), []
    monkeypatch.setattr(mixing, "Model", type("Seen", (mixing.Model,), {
        "__init__": lambda self, fitted: (held.append(fitted), mixing.Model.__mro__[1].__init__(self, fitted))[1]}))
    codes = [mixing.train(mixing.packed_chunks(docs.repartition(n)))[1] for n in (1, 3)]
    assert all((a == b).all() for a, b in zip(*held))
    # All bits by brute force: nodes of all training rows, less the row's own.
    tokens = mixing.Tokens(pa.array([t for _, t in rows], pa.string()))
    train = mixing._train_rows([i for i, _ in rows])
    distinct, inverse = np.unique(tokens.hash, return_inverse=True)
    n = np.bincount(inverse[train[tokens.row]], minlength=len(distinct))
    assert sum(held[0][1]) > 0 and codes[0].byte_lengths.tolist() == codes[1].byte_lengths.tolist()
    letters = Counter(b"".join((t or "").encode().lower() for (_, t), x in zip(rows, train) if x))
    letters[0] = letters[32]
    assert codes[0].byte_lengths.tolist() == mixing.huffman(np.array([letters[i] + 1 for i in range(256)]))[1].tolist()
    k = mixing._classes(n)
    bits = codes[0].lengths[k] + codes[0].bits[k]
    spelled = sum(len(w) + 1 for (_, t), x in zip(rows, train) if x for w in (t or "").encode().split()
                  if n[np.searchsorted(distinct, mixing.Tokens(pa.array([w.decode()])).hash[0])] < 2)
    words = int(bits[inverse[train[tokens.row]]].sum())
    assert words + spelled <= int(held[0][1].sum()) <= words + 12 * spelled


def test_scores_take_out_own_counts():
    """A row's own counts are those of its symbols' nodes, by predictor and row."""
    rng = np.random.default_rng(4)
    texts = pa.array([" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 400) if x < 900) for _ in range(5)] + ["", "w1"])
    t = mixing.Tokens(texts)
    distinct, n = np.unique(t.hash, return_counts=True)
    words = mixing.Words(distinct, n, int((n == 1).sum()), np.ones(256, np.int64))
    symbols, key, code, firsts, number, row = mixing._events([(0, len(texts), t)], words)
    s = symbols[0]
    mine = mixing.expand(s, 0, len(s.code), firsts[0], *mixing._own(key[number], code[number], row))[3]
    paths = [format(c, "064b")[:k] for c, k in zip(s.code.tolist(), s.length.tolist())]
    for i in range(3):
        place = list(zip(s.row.tolist(), s.context[i].tolist()))
        nodes = Counter((c, p[:j]) for c, p in zip(place, paths) for j in range(len(p) + 1))
        want = [[nodes[c, p[:j]], nodes[c, p[:j + 1]]] for c, p in zip(place, paths) for j in range(len(p))]
        assert mine[i].T.tolist() == want


def test_scores_fitted_weights_are_the_optimum():
    """Cells drawn from known weights give these back."""
    rng = np.random.default_rng(2)
    cell = rng.integers(0, mixing.LEVELS**3, 4000) + 5 * mixing.LEVELS**3
    x = np.stack([(cell // mixing.LEVELS**(2 - i) % mixing.LEVELS - mixing.LEVELS // 2) / mixing.FINE for i in range(3)])
    p = 1 / (1 + np.exp(-(np.array([0.2, 0.5, 0.4]) @ x + 0.1)))
    n = 100000
    ones = np.rint(n * p).astype(np.int64)
    model = mixing.Model([np.concatenate([2 * cell, 2 * cell + 1]), np.concatenate([n - ones, ones])])
    assert np.allclose(model.weights[:3, 5], [0.2, 0.5, 0.4], atol=0.01) and abs(0.3 * model.weights[3, 5] - 0.1) < 0.01


def test_scores_empty(no_docs):
    assert mixing.scores(no_docs).count() == 0


# -- whole queries against their SQL

@pytest.mark.parametrize("name", ["op4_substrings", "op10_decontaminate"])
def test_query_matches_sql(spark, sf_dir, name):
    from dealscreen.llm.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert Counter(map(tuple, QUERIES[name](spark, sf_dir).select(columns).collect())) == Counter(want.fetchall())


def test_piece_draws_and_texts_are_made_at_once(monkeypatch):
    """A batch's draws for all texts' parts are one call, and so are the texts of its samples."""
    vocabulary, calls = pieces.pieces(pieces.MODEL), []
    texts = [f"some words {i} here é \U0001f600" for i in range(40)] + ["", " ", "one"]
    plain = pieces._truncated
    monkeypatch.setattr(pieces, "_truncated", lambda *x: calls.append(len(x[0])) or plain(*x))
    made = pieces.sample(pa.array(texts), np.arange(len(texts), dtype=np.uint64), 1, vocabulary)
    assert len(calls) == 1
    ids = [s[0][0] for s in made]
    assert pieces.decoded(ids, vocabulary) == [pieces.decode(i, vocabulary) for i in ids] == texts
    assert pieces.decoded([], vocabulary) == [] and pieces.decoded([np.empty(0, np.int32)], vocabulary) == [""]
