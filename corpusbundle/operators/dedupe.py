"""Keyed last-wins de-duplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbundle.operators.keys import with_repeated


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the one with the greatest ``order`` (name a tie-breaker last).

    An aggregate instead of a ``row_number`` window: each map task keeps one row
    per key before the shuffle, so a key with a third of all rows stays cheap. It sorts
    whole rows; for wide ones see ``keep_last_wide``.
    """
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    return df.groupBy(*keys).agg(last).select(*keys, "_last.*").select(*df.columns)


def keep_last_wide(df: DataFrame, keys: Sequence[str], order: Sequence[str], **bounds: int) -> DataFrame:
    """``keep_last`` for rows that are costly to move.

    A first pass over the keys alone finds those that occur again. Rows of all other keys stay
    where they are read, whatever their number; only copies are merged. The first pass runs
    when this is called. ``bounds`` limit what it broadcasts (see ``with_repeated``); beyond them
    all rows are merged in a shuffle.
    """
    marked = with_repeated(df, F.xxhash64(*keys), "_again", **bounds)
    if marked is None:
        return keep_last(df, keys, order)
    once = marked.filter("not _again").drop("_again")
    return once.unionByName(keep_last(marked.filter("_again").drop("_again"), keys, order))
