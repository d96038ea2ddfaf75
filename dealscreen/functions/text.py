"""String, number-from-text and timestamp helpers as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealscreen.functions.deal_math import _col

# Patterns and formats that define results.
APN_OUTER_SPACE = " \t\n\x0b\f\r"  # whitespace stripped from both ends of the raw parcel number
APN_DROP_CHARS = "- "               # hyphens and spaces removed after that
NON_NUMERIC = r"[^0-9.]"            # everything but digits and '.'
PULL_LABEL_FORMAT = "yyyyMMdd_HHmmss"      # incremental-pull batch label (UTC)
PORTAL_LABEL_FORMAT = "yyyyMMdd'T'HHmmss"  # portal batch label (UTC)
ISO_UTC_FORMAT = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def normalize_apn(raw) -> Column:
    """Parcel number key: strip outer whitespace, upper-case, drop '-' and ' '.

    Null stays null; an all-blank value becomes '' (callers decide whether
    a blank key may join, see ``apn_key``).
    """
    c = _col(raw)
    return F.translate(F.upper(F.btrim(c, F.lit(APN_OUTER_SPACE))), APN_DROP_CHARS, "")


def apn_key(raw) -> Column:
    """``normalize_apn`` with blank mapped to null, so blanks never join."""
    return F.nullif(normalize_apn(raw), F.lit(""))


def number_from_text(text) -> Column:
    """Digits and dots only, then a double; blank or unparsable -> null.

    '$350,000' -> 350000.0; '1.2.3' -> null.
    """
    cleaned = F.regexp_replace(_col(text), NON_NUMERIC, "")
    return F.when(cleaned != "", cleaned.try_cast("double"))


def nullif_zero(x) -> Column:
    """Falsy-to-null for numbers: 0 (and null) -> null."""
    c = _col(x)
    return F.when(c != 0, c)


def batch_label(ts, fmt: str = PULL_LABEL_FORMAT) -> Column:
    """Batch label text of a timestamp, in the session time zone (UTC)."""
    return F.date_format(_col(ts), fmt)


def iso_utc(ts) -> Column:
    return F.date_format(_col(ts), ISO_UTC_FORMAT)


# Fixed value: a figure with a thousands or millions letter behind it, which ``number_from_text`` does not scale.
SCALED_FIGURE = r"(?i)[0-9]\s*(?:k|m|mm|mil|million|thousand)(?![a-z])"


def suspicious_price(text) -> Column:
    """True where the price text's figure has a scale letter ($1.2M reads as 1.2), or holds more than one figure or dot."""
    c = F.coalesce(_col(text), F.lit(""))
    figures = F.regexp_extract_all(F.regexp_replace(c, ",", ""), F.lit(r"[0-9.]+"), F.lit(0))
    return c.rlike(SCALED_FIGURE) | (F.size(F.filter(figures, lambda f: f.rlike("[0-9]"))) > 1) | F.exists(
        figures, lambda f: f.rlike(r"[.].*[.]"))
