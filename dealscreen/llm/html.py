"""Main text of web pages by a site style tree.

Every page becomes a DOM (own reader for broken markup); the DOMs of a host are merged by path, a node's path being the
tags and class names from the root. For each merged node the spread of its presentations (sequences of child elements)
and for each content node the spread of its text over the host's pages give entropy-based importances:

* content: 1 - H, where H = ln c / ln m for a text found on c of the m pages that have the node
* presentation: the entropy of the node's child sequences over its m pages, divided by ln m
* branch: ``1 - GAMMA`` times its presentation plus ``GAMMA`` times the mean importance of the content below it

Contents and branches below ``THRESHOLD`` are removed from each page. Nodes seen on fewer than ``MIN_PAGES`` pages of a
host keep importance 1. Pages of a host with the same main part are one page for all counts, so that an article that is
copied to many addresses isn't taken for a template. All pages of a host, with marked articles or without, form one tree.

Marks in the markup shift these importances:

* Where a page marks its article (``article`` with ``MARK_SHARE`` of the text or more, else ``main``), importances i inside it
  are raised to 1 - (1 - i) ** ``RAISE``: passages that many articles quote stay, what stands in nearly all of them goes. What is
  outside of it goes. An ``article`` with less of the text is a teaser and marks nothing.
* Menus, footers, sidebars, forms, scripts, styles, adverts and reader comments that elements or class names tell have
  importance 0. Other class names that may tell a purpose (``HINTS``) have it outside of articles only; inside, such a branch
  goes if its text is found on two or more pages or is mostly links.

Text: character references decoded, white space in a block becomes one space, blocks are joined by \\n in page order.

Defined cases: null or empty html gives empty text; null urls and urls without a host form one host; repeated rows and
ids each get a row; broken, unclosed and cut markup is read as browsers do (open elements end with the page).
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple
from urllib.parse import urlsplit

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from dealscreen.llm.common import chunks, materialise, read, scratch_dir

GAMMA, THRESHOLD, MIN_PAGES, RAISE, MARK_SHARE = 0.9, 0.2, 8, 4, 0.25

# HTML element names by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template textarea title iframe svg math xmp noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby "
             "s samp small span strike strong sub sup time tt u var wbr".split())
NEVER = set("head nav footer aside form button select option input fieldset dialog menu object canvas audio video "
            "map".split()) | RAW
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"),
           "th": ("tr", "table"), "option": ("select",)}
#: Words in class, id and role that state such a purpose.
PURPOSE = set("ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav "
              "navbar navigation navi menu breadcrumb breadcrumbs footer masthead sidebar aside complementary "
              "contentinfo cookie cookies consent gdpr notice notices alert popup modal overlay comment comments disqus "
              "reply replies respond related recommended share sharing social newsletter subscribe subscription signup "
              "login search searchbox form toolbar widget pager pagination skip".split())
OUTSIDE = {"header", "top", "topbar"}
#: Those of them that also name ordinary parts of an article.
HINTS = set("notice notices alert related recommended widget overlay complementary skip search pager".split())
REMARKS = {"comment", "comments", "reply", "replies", "respond"}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)"
                    r"|</?[a-zA-Z][^<>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class _Node:
    __slots__ = ("tag", "path", "children", "weight", "article", "main", "hint", "link")

    def __init__(self, tag, path, weight, article, main, hint, link):
        self.tag, self.path, self.children, self.weight = tag, path, [], weight
        self.article, self.main, self.hint, self.link = article, main, hint, link


class Block(NamedTuple):
    path: str
    text: str
    article: bool
    main: bool
    hint: bool


def page_blocks(source: str | None) -> tuple[list[Block], list[bool], dict[str, list[str]], bool]:
    """Blocks that no purpose rules out, which of them are in the main part, child sequences by path, whether that is marked."""
    root = _Node("", "", True, False, False, False, False)
    stack, found, styles, text, linked = [root], [], {}, [], []

    def flush():
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            links = sum(map(len, linked))
            text.clear()
            linked.clear()
            if joined and stack[-1].weight:
                node = next(n for n in reversed(stack) if n.tag not in INLINE)
                if not (node.hint and 2 * links >= len(joined)):
                    found.append(Block(node.path, joined, node.article, node.main, node.hint))

    def add(part):
        text.append(part)
        if stack[-1].link:
            linked.append(part)

    def close(depth):
        while len(stack) > depth:
            if stack[-1].tag not in INLINE:
                flush()
            node = stack.pop()
            styles.setdefault(node.path, []).append(",".join(node.children))

    def close_up_to(tags, barrier):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                close(i)
                return
            if stack[i].tag in barrier:
                return

    source = source or ""
    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            add(source[at:])
            break
        if m.start() > at:
            add(source[at:m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in VOID:
                if tag == "br":
                    text.append(" ")
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if tag not in INLINE:
                        flush()
                    close(i)
                    break
                if stack[i].tag not in INLINE and tag in INLINE:
                    break
            else:
                flush() if tag not in INLINE else None
            continue
        if tag == "br":
            text.append(" ")
            continue
        block = tag not in INLINE
        if block:
            flush()
            if tag in CLOSES:
                close_up_to(CLOSES[tag], BARRIER[tag])
            elif tag not in RAW:
                close_up_to(("p",), ("article", "section", "div", "table", "td", "li", "body", "button", "object"))
        words, sign = set(), tag
        for name, *value in _ATTRIBUTE.findall(m[3]) if m[3] else ():
            words.update(_WORD.findall(_CAMEL.sub(" ", "".join(value)).lower()))
        if words:
            sign += "." + ".".join(sorted(words))
        up = stack[-1]
        up.children.append(sign)
        article, main = up.article or tag == "article", up.main or tag == "main" or "main" in words and tag != "body"
        inside = article or main
        if tag in ("html", "body", "article", "main"):
            good = not words & REMARKS
        else:
            ruled = words & PURPOSE - HINTS if inside else words & (PURPOSE | OUTSIDE)
            good = tag not in NEVER and not ruled and (inside or tag != "header")
        if tag in VOID:
            continue
        if tag in RAW:
            raw = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = raw.end() if raw else end
            continue
        stack.append(_Node(tag, f"{up.path}/{sign}", up.weight and good, article and good, main and good,
                           up.hint or bool(inside and words & HINTS), up.link or tag == "a"))
    flush()
    close(0)
    own = sum(len(b.text) for b in found if b.article)
    if own and own >= MARK_SHARE * sum(len(b.text) for b in found):
        return found, [b.article for b in found], styles, True
    if any(b.main for b in found):
        return found, [b.main for b in found], styles, True
    return found, [True] * len(found), styles, False


def _host(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").removeprefix("www.")
    except ValueError:
        return ""


def _key(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\0".join(parts)) - (1 << 63)


_PAIR = pa.struct([("key", pa.int64()), ("hash", pa.int64())])
_BLOCK = pa.struct([("key", pa.int64()), ("hash", pa.int64()), ("hint", pa.bool_()), ("inside", pa.bool_())])
_UPS = pa.struct([("key", pa.int64()), ("ups", pa.list_(pa.int64()))])
_PARSED = ("row {row}, marked boolean, main bigint, blocks array<struct<key:bigint,hash:bigint,hint:boolean,inside:boolean>>, texts array<string>, "
           "styles array<struct<key:bigint,hash:bigint>>, ups array<struct<key:bigint,ups:array<bigint>>>")


def parsed(pages: DataFrame) -> DataFrame:
    """row (the page without html), whether it marks its main part, a hash of that part, blocks with their node and text hashes
    and whether they are in it, the texts of those that are, its nodes' presentations and the ancestors of nodes with text."""
    rows = pages.select(F.struct(*[c for c in pages.columns if c != "html"]).alias("row"), "url", "html")
    schema = _PARSED.format(row=rows.schema["row"].dataType.simpleString())

    def parse(batches):
        for b in chunks(batches, "html"):
            marked, mains, blocks, texts, styles, ups = [], [], [], [], [], []
            for url, source in zip(b.column("url").to_pylist(), b.column("html").to_pylist()):
                host = _host(url)
                found, main, shapes, own = page_blocks(source)
                keys = {p: _key(host, p) for p in shapes} | {x.path: _key(host, x.path) for x in found}
                marked.append(own)
                mains.append(_key(host, *[x.text for x, inside in zip(found, main) if inside]))
                blocks.append([{"key": keys[x.path], "hash": _key(x.text), "hint": x.hint, "inside": inside}
                               for x, inside in zip(found, main)])
                texts.append([x.text if inside else None for x, inside in zip(found, main)])
                styles.append([{"key": keys[p], "hash": _key(*s)} for p, s in shapes.items()])
                above = []
                for p in {x.path for x in found}:
                    steps = p.split("/")
                    chain = ["/".join(steps[:i]) for i in range(2, len(steps))]
                    above.append({"key": keys[p], "ups": [keys.get(x) or _key(host, x) for x in chain]})
                ups.append(above)
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), pa.array(marked, pa.bool_()), pa.array(mains, pa.int64()), pa.array(blocks, pa.list_(_BLOCK)),
                 pa.array(texts, pa.list_(pa.string())), pa.array(styles, pa.list_(_PAIR)), pa.array(ups, pa.list_(_UPS))],
                names=["row", "marked", "main", "blocks", "texts", "styles", "ups"])

    return rows.mapInArrow(parse, schema)


def importances(pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> tuple[DataFrame, DataFrame]:
    """Contents (key, hash, importance) and nodes with text (key, importance: the least of the branches that hold it), from the
    merged trees of all hosts; only those that can be removed.

    What is joined to pages or blocks is written first, so that Spark picks the join by its true size.
    """
    apart = materialise(pages.groupBy("main").agg(F.min("uid").alias("uid")).select("uid"))
    pages = pages.join(apart, "uid", "left_semi")
    nodes = (pages.select(F.inline("styles")).groupBy("key", "hash").agg(F.count("*").alias("c"))
             .groupBy("key").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.ln("c")).alias("s"))
             .where(F.col("m") >= min_pages).select("key", F.ln("m").alias("ln_m"),
                                                    (1 - F.col("s") / F.col("m") / F.ln("m")).alias("presentation")))
    found = F.array_distinct(F.transform("blocks", lambda b: b.dropFields("inside")))
    texts = materialise(pages.select(F.inline(found)).groupBy("key", "hash", "hint").agg(F.count("*").alias("c")))
    # Rarer ones are above the threshold on any node, so they need not be joined.
    content = (texts.where((F.col("c") >= min_pages ** (1 - threshold)) & ~F.col("hint")).join(nodes, "key")
               .select("key", "hash", (1 - F.ln("c") / F.col("ln_m")).alias("importance"))
               .union(texts.where(F.col("hint") & (F.col("c") > 1)).select("key", "hash", F.lit(0.0))))
    above = pages.select(F.inline("ups")).groupBy("key").agg(F.first("ups").alias("ups"))
    # Of all contents c(1 - ln c / ln m) below a node: sums by node first, then by branch.
    sums = texts.groupBy("key").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.ln("c")).alias("s")).join(
        nodes, "key", "left").select("key", "n", F.coalesce(F.col("n") - F.col("s") / F.col("ln_m"), "n").alias("v"))
    chains = above.select(F.col("key").alias("own"), F.explode(F.concat(F.array("key"), "ups")).alias("key"))
    means = (chains.join(sums.withColumnRenamed("key", "own"), "own").groupBy("key")
             .agg((F.sum("v") / F.sum("n")).alias("mean")))
    branches = nodes.join(means, "key").select(
        "key", ((1 - GAMMA) * F.col("presentation") + GAMMA * F.col("mean")).alias("importance")).where(
        F.col("importance") < threshold)
    least = chains.join(branches, "key").groupBy(F.col("own").alias("key")).agg(F.min("importance").alias("importance"))
    return materialise(content), materialise(least)


def main_text(pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES) -> DataFrame:
    """row (the page without html) and text."""
    path = scratch_dir(pages.sparkSession)
    (parsed(pages).withColumn("uid", F.monotonically_increasing_id())
     .write.option("compression", "zstd").parquet(path))
    tree = pages.sparkSession.read.parquet(path)
    contents, branches = importances(tree, threshold, min_pages)
    blocks = tree.select("uid", "marked", F.posexplode("blocks").alias("at", "b")).where("b.inside").select(
        "uid", "marked", "at", "b.key", "b.hash")
    low = F.when(F.col("marked"), 1 - F.pow(1 - F.col("importance"), F.lit(RAISE))).otherwise(F.col("importance")) < threshold
    drops = materialise(blocks.join(contents, ["key", "hash"]).where(low).select("uid", "at")
             .union(blocks.join(branches, "key").where(low).select("uid", "at"))
             .groupBy("uid").agg(F.collect_set("at").alias("drop")))
    kept = F.filter("texts", lambda t, i: t.isNotNull() & F.coalesce(~F.array_contains("drop", i), F.lit(True)))
    return tree.select("uid", "row", "texts").join(drops, "uid", "left").select("row", F.array_join(kept, "\n").alias("text"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", "html")
    return main_text(pages).select("row.page_id", "row.url", "text", F.char_length("text").cast("long").alias("n_chars"))
