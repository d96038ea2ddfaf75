"""JSON navigation on VARIANT values with key fallbacks.

A key that is missing and a key holding JSON null are treated alike (both
absent), so a fallback key is used in either case; a value of the wrong type
becomes null for that row instead of failing the whole page or source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dealscreen.functions.deal_math import _col


def parse(text) -> Column:
    """Text -> VARIANT; null for blank or malformed JSON."""
    return F.try_parse_json(_col(text))


def get(v, path: str, typ: str = "variant") -> Column:
    return F.try_variant_get(_col(v), path, typ)


def first(v, paths: Sequence[str], typ: str, default=None) -> Column:
    """Value at the first present path (``h.get(a, h.get(b, default))``)."""
    cols = [get(v, p, typ) for p in paths]
    if default is not None:
        cols.append(F.lit(default).cast(typ))
    return F.coalesce(*cols) if len(cols) > 1 else cols[0]


def kind(v) -> Column:
    """Top-level JSON kind: OBJECT, ARRAY, STRING, BIGINT, DOUBLE, BOOLEAN, ... (null if absent)."""
    return F.split(F.schema_of_variant(_col(v)), "<", 2).getItem(0)


def truthy(v) -> Column:
    """Python truthiness of a JSON value: non-empty list / object / string, non-zero number, true.

    A non-empty list is recognised from its first element, so the common case
    never walks the whole value; the kind is only computed otherwise.
    """
    c = _col(v)
    k = kind(c)
    return F.coalesce(
        F.when(get(c, "$[0]").isNotNull(), F.lit(True))
        .when(k == "ARRAY", F.lit(False))
        .when(k == "OBJECT", F.size(get(c, "$", "map<string,variant>")) > 0)
        .when(k == "STRING", F.length(get(c, "$", "string")) > 0)
        .when(k == "BOOLEAN", get(c, "$", "boolean"))
        .when(k == "VOID", F.lit(False))
        .otherwise(get(c, "$", "double") != 0),
        F.lit(False),
    )


def first_truthy_of(cols: Sequence[Column]) -> Column:
    """``a or b or c`` over already-extracted values (else null)."""
    out = None
    for x in reversed(list(cols)):
        out = F.when(truthy(x), x) if out is None else F.when(truthy(x), x).otherwise(out)
    return out


def first_truthy(v, paths: Sequence[str]) -> Column:
    """``a or b or c``: the first truthy value among the paths (else null)."""
    return first_truthy_of([get(v, p) for p in paths])


def as_list(v, parse_strings: bool = False) -> Column:
    """The value as ``array<variant>``; a JSON string holding a list is parsed
    when ``parse_strings``; anything else is an empty list."""
    c = _col(v)
    arr = get(c, "$", "array<variant>")
    empty = F.array().cast("array<variant>")
    if parse_strings:
        inner = get(parse(get(c, "$", "string")), "$", "array<variant>")
        arr = F.when(kind(c) == "STRING", inner).otherwise(arr)
    return F.coalesce(arr, empty)


def text_of(v, path: str, default: str = "") -> Column:
    """``str(h.get(key, default))`` for scalar JSON values."""
    return F.coalesce(get(v, path, "string"), F.lit(default))
