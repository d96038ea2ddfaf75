"""Checks of result pages that are followed by their links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dealscreen import fixtures as fx
from dealscreen import oracle_sql as osql
from dealscreen.checks import register
from dealscreen.checks.landing import ENVELOPE_RECORD
from dealscreen.sources.page_chain import PageChain, page_chain


def _chain(spark: SparkSession, sf: str) -> PageChain:
    pages = fx.linked_pages(spark, sf)
    starts = pages.select("feed").distinct().withColumn("url", F.concat(F.lit(f"{fx.LINK_BASE}/page-"), "feed", F.lit("-0")))
    return page_chain(pages, starts, ENVELOPE_RECORD, fx.LINK_BASE, newest=["delivery"])


_LINKS = f"""
p AS (SELECT page, feed, i, {fx.LINK_NEXT} AS nxt, NOT ({fx.LINK_MISSING}) AS present, {fx.LINK_CUT} AS cut, {fx.LINK_REPEATED} AS twice
  FROM (SELECT DISTINCT {fx.LINKED_PAGE} AS page, {fx.LINKED_PAGE} // {fx.PAGES_PER_FEED} AS feed, {fx.LINKED_PAGE} % {fx.PAGES_PER_FEED} AS i,
          max({fx.LINKED_PAGE}) OVER () AS last_page FROM fx_bronze) x),
links AS (SELECT *, CASE WHEN cut THEN NULL ELSE nxt END AS follow FROM p WHERE present),
chain AS (
  SELECT DISTINCT feed, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS hop FROM links
  UNION ALL
  SELECT c.feed, l.follow, c.hop + 1 FROM chain c JOIN links l ON c.feed = l.feed AND c.i = l.i
  WHERE l.follow IS NOT NULL AND c.hop < {2 * fx.PAGES_PER_FEED}),
reach AS (SELECT feed, i, min(hop) AS hop FROM chain GROUP BY feed, i)"""


def _sql(select: str) -> str:
    return osql.with_base(_LINKS.strip()).replace("WITH ", "WITH RECURSIVE ", 1) + select


register("page_chain", _sql(f"""
SELECT CAST(r.feed AS VARCHAR) AS feed, r.hop AS "at", b.ListingKey, b.ListPrice, b.ModificationTimestamp, b.seq
FROM reach r JOIN links l ON r.feed = l.feed AND r.i = l.i
JOIN fx_bronze b ON {fx.LINKED_PAGE.replace('seq', 'b.seq')} = l.page WHERE NOT l.cut"""))(
    lambda spark, sf: _chain(spark, sf).records.drop("nth"))

register("page_chain_breaks", _sql(f"""
SELECT CAST(feed AS VARCHAR) AS feed, kind, '{fx.LINK_BASE}/page-' || CAST(feed AS VARCHAR) || '-' || CAST(i AS VARCHAR) AS url, coalesce(hop, -1) AS "at"
FROM (
  SELECT r.feed, 'missing' AS kind, r.i, r.hop FROM reach r LEFT JOIN links l ON r.feed = l.feed AND r.i = l.i WHERE l.i IS NULL
  UNION ALL
  SELECT r.feed, 'cycle', r.i, r.hop FROM reach r JOIN links l ON r.feed = l.feed AND r.i = l.i
    JOIN reach t ON t.feed = l.feed AND t.i = l.follow WHERE t.hop <= r.hop
  UNION ALL
  SELECT r.feed, 'unparsed', r.i, r.hop FROM reach r JOIN links l ON r.feed = l.feed AND r.i = l.i WHERE l.cut
  UNION ALL
  SELECT l.feed, 'orphan', l.i, NULL FROM links l LEFT JOIN reach r ON r.feed = l.feed AND r.i = l.i WHERE r.i IS NULL
  UNION ALL
  SELECT l.feed, 'repeated', l.i, r.hop FROM links l LEFT JOIN reach r ON r.feed = l.feed AND r.i = l.i WHERE l.twice) x"""))(
    lambda spark, sf: _chain(spark, sf).breaks.withColumn("at", F.coalesce("at", F.lit(-1))))
