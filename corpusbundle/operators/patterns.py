"""Patterns that come in a table: each project has its own lists."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusbundle.functions.globs import PATTERN_KINDS, matches_regex
from corpusbundle.operators.lookups import lookup_join


def compiled_patterns(patterns: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., one regex column for each kind) from rows (by..., kind, pattern).

    Each row is compiled on its own, so a broken pattern takes none of the others with it;
    then the regexes of a group are put together. Kinds are ``glob``, ``ignore`` and
    ``generated``; other kinds, null and empty patterns match nothing. A group without
    a pattern of some kind has null there.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[[*by, "kind"]].copy()
            pairs = zip(batch["kind"], batch["pattern"])
            out["regex"] = pd.Series([PATTERN_KINDS[k]([p]) for k, p in pairs], index=batch.index, dtype=object)
            yield out

    known = patterns.filter(F.col("kind").isin(list(PATTERN_KINDS)) & (F.col("pattern") != ""))
    distinct = known.select(*by, "kind", "pattern").distinct()
    schema = T.StructType([*(patterns.schema[c] for c in (*by, "kind")), T.StructField("regex", T.StringType())])
    each = distinct.mapInPandas(run, schema)
    return each.groupBy(*by).agg(*(_any_regex(kind).alias(kind) for kind in PATTERN_KINDS))


def _any_regex(kind: str) -> Column:
    """One regex that matches what any of the group's does, in one order, so that reruns agree."""
    own = F.sort_array(F.collect_set(F.when(F.col("kind") == kind, F.concat(F.lit("(?:"), "regex", F.lit(")")))))
    return F.nullif(F.array_join(own, "|"), F.lit(""))


def with_pattern_matches(
    files: DataFrame, patterns: DataFrame, by: Sequence[str], spread_by: Sequence[str] = ("rel_path",), **options
) -> DataFrame:
    """Add ``glob_hit``, ``ignored`` and ``generated`` to files by the patterns of their group.

    The small side carries one regex for each group and kind; files meet it by ``by`` (see
    ``lookup_join`` for large pattern tables and hot groups). Files of groups without patterns
    match nothing.
    """
    rules = compiled_patterns(patterns, by)
    names = {"glob": "glob_hit", "ignore": "ignored", "generated": "generated"}
    renamed = rules.withColumnsRenamed({k: f"_{k}_regex" for k in names})
    met = lookup_join(files, renamed, list(by), list(spread_by), how="left", **options)
    hits = {name: matches_regex(F.col("rel_path"), F.col(f"_{k}_regex")) for k, name in names.items()}
    return met.withColumns(hits).drop(*(f"_{k}_regex" for k in names))
