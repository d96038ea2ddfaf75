"""Result pages in the order of their links: the records of the chain that begins at each feed's start page.

Pages arrive as files in any order, some more than once, some not at all. What counts is what a client that follows
the links would have read: the start page, the page its link names, and so on. The positions come from pointer doubling:
after round k every page knows the page 2^k links further on, so a chain of n pages takes log2(n) rounds of joins on
(feed, url), each written as a table. Only urls are carried; bodies are joined to the positions at the end.

What a link client would not have seen, or could not, is told by ``breaks``:

* ``missing``   a link (or start) to a page that is not there
* ``cycle``     a page whose link leads back to a page of the chain (each page counts once)
* ``unparsed``  a page of the chain that is no envelope; the chain ends there, its text can be set aside
* ``orphan``    a page that no chain reaches; its records are left out
* ``repeated``  a page that was delivered more than once; the latest delivery counts (``newest``), then the smallest text

Null or empty links end a chain; feeds and urls must not be null (such pages are orphans).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dealscreen.config import pin
from dealscreen.operators.dedup import dedup_latest
from dealscreen.schemas import CORRUPT_COL
from dealscreen.sources.files import PAGE_NEXT_LINK_KEY, PAGE_VALUE_KEY, envelope_schema


def absolute(url: Column, base: str) -> Column:
    """A link without a scheme is relative to the service's base address."""
    root = base.rstrip("/")
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), url).otherwise(
        F.concat(F.lit(root + "/"), F.regexp_replace(url, r"^/+", "")))


def read_links(pages: DataFrame, record_schema: T.StructType, base: str, newest: Sequence[str] = (), text: str = "body") -> DataFrame:
    """feed, url, next, parsed, n (deliveries), body: one row a page, its latest delivery."""
    schema = T.StructType([*envelope_schema(record_schema).fields, T.StructField(CORRUPT_COL, T.StringType(), True)])
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT_COL}
    keyed = pages.where(F.col("feed").isNotNull() & F.col("url").isNotNull()).select(
        F.col("feed").cast("string").alias("feed"), absolute(F.col("url"), base).alias("url"), F.col(text).alias("body"), *newest)
    times = keyed.groupBy("feed", "url").agg(F.count(F.lit(1)).alias("n"))
    latest = dedup_latest(keyed.withColumn("_smallest", F.sha2("body", 256)), ["feed", "url"], [*newest, "_smallest"])
    env = F.from_json("body", schema, opts)
    link = F.nullif(F.trim(env[PAGE_NEXT_LINK_KEY]), F.lit(""))
    return latest.join(times, ["feed", "url"]).select(
        "feed", "url", absolute(link, base).alias("next"),
        (F.col("body").isNotNull() & env[CORRUPT_COL].isNull()).alias("parsed"), "n", "body")


def positions(links: DataFrame, starts: DataFrame) -> DataFrame:
    """feed, url, at: every url on a feed's chain with its distance in links from the start, by pointer doubling.

    Urls that no page has (a missing link) are included; on a cycle the first visit counts.
    """
    reach = pin(starts.select("feed", "url", F.lit(0).cast("long").alias("at")).distinct(), "chain-reach")
    jump = links.where(F.col("next").isNotNull()).select("feed", "url", F.col("next").alias("to"))
    known, step = reach.count(), 1
    while known:
        ahead = reach.join(jump, ["feed", "url"]).select("feed", F.col("to").alias("url"), (F.col("at") + step).alias("at"))
        reach = pin(reach.unionByName(ahead).groupBy("feed", "url").agg(F.min("at").alias("at")), "chain-reach")
        # Distances have no gaps: a round without a new url has seen the ends of all chains.
        n = reach.count()
        if n == known:
            break
        known, step = n, 2 * step
        further = jump.select("feed", F.col("url").alias("to"), F.col("to").alias("then"))
        jump = pin(jump.join(further, ["feed", "to"]).select("feed", "url", F.col("then").alias("to")), "chain-jump")
    return reach


@dataclass(frozen=True)
class PageChain:
    """``records``: feed, at (page), nth (in its page) and the record's columns; ``breaks``: feed, kind, url, at; ``unparsed``: texts."""

    records: DataFrame
    breaks: DataFrame
    unparsed: DataFrame


def page_chain(pages: DataFrame, starts: DataFrame, record_schema: T.StructType, base: str, newest: Sequence[str] = (),
               text: str = "body") -> PageChain:
    """``pages``: feed, url, ``text`` and the ``newest`` columns; ``starts``: feed, url of each feed's first page."""
    links = pin(read_links(pages, record_schema, base, newest, text), "chain-pages")
    first = starts.select(F.col("feed").cast("string").alias("feed"), absolute(F.col("url"), base).alias("url"))
    first = first.groupBy("feed").agg(F.min("url").alias("url"))
    at = positions(links.select("feed", "url", "next"), first)
    chain = links.join(at, ["feed", "url"])
    records = F.from_json("body", envelope_schema(record_schema))[PAGE_VALUE_KEY]
    rows = chain.where("parsed").select("feed", "at", F.posexplode(records).alias("nth", "_r")).select("feed", "at", "nth", "_r.*")

    slim = links.select("feed", "url", "next", "parsed", "n")
    held = slim.join(at, ["feed", "url"])
    after = at.select("feed", F.col("url").alias("next"), F.col("at").alias("to"))
    cycles = held.join(after, ["feed", "next"]).where("to <= at")
    given = pages.where(F.col("feed").isNull() | F.col("url").isNull()).select(F.col("feed").cast("string"), F.col("url").cast("string"))

    def kind(name: str, df: DataFrame, has_at: bool = True) -> DataFrame:
        place = F.col("at") if has_at else F.lit(None).cast("long").alias("at")
        return df.select("feed", F.lit(name).alias("kind"), "url", place)

    parts = [kind("cycle", cycles), kind("unparsed", held.where("NOT parsed")), kind("repeated", slim.where("n > 1").join(at, ["feed", "url"], "left")),
             kind("missing", at.join(slim, ["feed", "url"], "left_anti")),
             kind("orphan", slim.join(at, ["feed", "url"], "left_anti"), False), kind("orphan", given, False)]
    breaks = parts[0]
    for p in parts[1:]:
        breaks = breaks.unionByName(p)
    return PageChain(rows, breaks, chain.where("NOT parsed").select("feed", "url", F.col("body").alias(CORRUPT_COL)))
