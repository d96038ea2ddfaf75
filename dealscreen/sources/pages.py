"""Saved web pages: title, blocked-page detection, embedded JSON islands and
home-card elements. Pages are rows (``page_id``, ``html``), so the work is
spread over the cluster like any other scan; nothing loads a browser.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dealscreen.functions import json as js
from dealscreen.functions.deal_math import _col

# Page patterns ((?s) = dot matches newlines).
TITLE_PATTERN = r"(?s)<title[^>]*>(.*?)</title>"
NEXT_DATA_PATTERN = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'
CAPTCHA_ELEMENT_PATTERN = r"""<[^>]*\sid\s*=\s*["']captcha["']"""
# Parts of a page without elements, start tags (quotes may hold ">"), and a tag's name and attributes in turn: the name,
# and its value in double quotes, in single quotes or without. Possessive, so that long tags need no stack.
NO_ELEMENTS_PATTERN = r"(?is)<!--.*?-->|<(script|style|textarea)\b.*?</\1\s*>"
TAG_PATTERN = r"""<[A-Za-z](?:[^>"']|"[^"]*+"|'[^']*+')*+>"""
ATTRIBUTE_PATTERN = r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+"""
CARD_ATTRIBUTE, CARD_VALUE = "data-rf-test-id", "homecard"
# The character references that attribute values may hold by name (numbers are decoded by rule).
NAMED_REFERENCES = {"quot": 34, "amp": 38, "apos": 39, "lt": 60, "gt": 62, "nbsp": 160}
REFERENCE_PATTERN = r"&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]{1,8});|[^&]++|&"


def page_title(html) -> Column:
    return F.regexp_extract(_col(html), TITLE_PATTERN, 1)


def blocked(html, layout: str) -> Column:
    """True when the page is an interstitial instead of results.

    layout a: title contains ``ERROR`` (case-sensitive) or ``captcha`` (any case);
    layout b: title contains ``captcha`` or the page has a ``#captcha`` element;
    layout c: title contains ``captcha``.
    """
    title = page_title(html)
    captcha = F.lower(title).contains("captcha")
    if layout == "a":
        return title.contains("ERROR") | captcha
    if layout == "b":
        return captcha | F.regexp_like(_col(html), F.lit(CAPTCHA_ELEMENT_PATTERN))
    if layout == "c":
        return captcha
    raise ValueError(f"unknown layout {layout!r}")


def filter_blocked_pages(pages: DataFrame, layout: str, html_col: str = "html") -> DataFrame:
    """Drop blocked pages (they contribute zero records)."""
    return pages.filter(~blocked(F.col(html_col), layout))


def extract_json_island(html, patterns: Sequence[str] = (NEXT_DATA_PATTERN,)) -> Column:
    """VARIANT of the first pattern whose (first) match parses as JSON, else null."""
    cands = [js.parse(F.regexp_extract(_col(html), p, 1)) for p in patterns]
    return F.coalesce(*cands) if len(cands) > 1 else cands[0]


def tag_attributes(tag: Column) -> Column:
    """Name (lower case) and value of a start tag's attributes, in order; '' for an attribute without value."""
    names, *quoted = [F.regexp_extract_all(tag, F.lit(ATTRIBUTE_PATTERN), F.lit(g)) for g in range(1, 5)]
    value = lambda x: F.concat(x["1"], x["2"], x["3"])  # noqa: E731  (at most one of them is not empty)
    every = F.transform(F.arrays_zip(names, *quoted), lambda x: F.struct(F.lower(x["0"]).alias("name"), value(x).alias("value")))
    return F.slice(every, F.lit(2), F.greatest(F.size(every) - 1, F.lit(0)))  # the first is the tag's name


def decoded(value: Column) -> Column:
    """Character references by number or common name become their characters; unknown ones stay."""
    def code(part: Column) -> Column:
        name = F.regexp_extract(part, "^&([A-Za-z]+);$", 1)
        named = F.lit(None).cast("int")
        for n, c in NAMED_REFERENCES.items():
            named = F.when(name == n, F.lit(c)).otherwise(named)
        digits = F.regexp_extract(part, "^&#([0-9]+);$", 1)
        hexes = F.regexp_extract(part, "^&#[xX]([0-9A-Fa-f]+);$", 1)
        number = F.when(digits != "", digits.try_cast("int")).when(hexes != "", F.conv(hexes, 16, 10).try_cast("int")).otherwise(named)
        return F.when(number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF), number)

    def character(part: Column) -> Column:
        return F.coalesce(F.decode(F.unhex(F.lpad(F.hex(code(part)), 8, "0")), "UTF-32"), part)

    parts = F.regexp_extract_all(value, F.lit(REFERENCE_PATTERN), F.lit(0))
    return F.when(value.contains("&"), F.array_join(F.transform(parts, character), "")).otherwise(value)


def _attribute(attributes: Column, name: str) -> Column:
    """The decoded value of the first attribute of that name; null without it."""
    found = F.filter(attributes, lambda x: x["name"] == name)
    return decoded(F.try_element_at(found, F.lit(1))["value"])


def homecard_ids(html) -> Column:
    """``id`` of every home-card element in page order ('' when it has none), however its attributes are written."""
    elements = F.regexp_replace(_col(html), NO_ELEMENTS_PATTERN, "")
    tags = F.regexp_extract_all(elements, F.lit(TAG_PATTERN), F.lit(0))
    cards = F.filter(F.transform(tags, tag_attributes), lambda a: _attribute(a, CARD_ATTRIBUTE) == CARD_VALUE)
    return F.transform(cards, lambda a: F.coalesce(_attribute(a, "id"), F.lit("")))
