"""Keep the latest version per key, deterministically.

``row_number() = 1`` over a window partitioned by the key is planned by
Spark as a *partial* ``WindowGroupLimit`` before the shuffle and a final one
after it: every map task already reduces each key to one row, so a hot key
(one listing re-sent in a third of all files) shrinks to one row per task
before it is exchanged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _latest_first(order: Sequence[str | Column]) -> list[Column]:
    out = []
    for o in order:
        out.append(F.col(o).desc_nulls_last() if isinstance(o, str) else o)
    return out


def dedup_latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per ``keys``: the first by ``order`` (names mean DESC NULLS LAST).

    ``order`` must be a total order within a key (end it with a unique
    column) so that the survivor does not depend on task timing. Rows whose
    key has a null are not deduplicated here (see ``null_key_rows``).
    """
    keys = list(keys)
    not_null = F.lit(True)
    for k in keys:
        not_null = not_null & F.col(k).isNotNull()
    w = Window.partitionBy(*keys).orderBy(*_latest_first(order))
    return (
        df.filter(not_null)
        .withColumn("_rn", F.row_number().over(w))
        .filter(F.col("_rn") == 1)
        .drop("_rn")
    )


def with_order(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """The order columns of ``df`` by name; typed nulls for those it lacks."""
    return [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in order]


def null_key_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that cannot be keyed (quarantine side of ``dedup_latest``)."""
    any_null = F.lit(False)
    for k in keys:
        any_null = any_null | F.col(k).isNull()
    return df.filter(any_null)
