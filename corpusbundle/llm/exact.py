"""Exact deduplication by progressive refinement: length, prefix hash, full hash.

Each level is one scan that does more work on fewer rows. A level counts its keys and
hands on those that occur again, or a bitmap sized to their number, so no text is
shuffled and every scan can tell for itself which rows are still in question. Only
rows whose length and prefix hash both occur again have their full content hashed;
equality rests on SHA-256 alone, so keys that collide cost time and never change a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbundle.llm.common import durable_table, spread_join, text_of
from corpusbundle.operators.keys import with_repeated

PREFIX = 256


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[Column] = ()
) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, and ``carry``.

    Of equal texts the row with the largest id stays; if that id occurs more than once
    in a group, one of its rows stays. A null text equals an empty one. A null id ranks
    below every other; keep_id is null if a group has no other. An empty table gives no
    rows. ``carry`` are named expressions over the columns of ``docs``; other columns
    are not read, whatever their names.
    """
    source = docs.select(
        F.col(id_col).alias("_id"), text_of(text_col).alias("_text"), F.struct(F.lit(0).alias("_none"), *carry).alias("_with")
    )
    size = F.xxhash64(F.octet_length("_text"))
    prefix = F.xxhash64(F.octet_length("_text"), F.substring("_text", 1, PREFIX))
    by_length = _marked(source, size, "_again", F.lit(True))
    by_prefix = _marked(by_length, F.when(F.col("_again"), prefix), "_open", F.col("_again"))
    rows = durable_table(
        by_prefix.select(
            "_id",
            F.monotonically_increasing_id().alias("_row"),
            F.when(F.col("_open"), F.sha2("_text", 256)).alias("_full"),
            "_with",
        )
    )
    groups = durable_table(
        rows.filter("_full is not null")
        .groupBy("_full")
        .agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("_size"))
    )
    shared = spread_join(rows.filter("_full is not null"), groups, "_full", "_size").select(
        "_id",
        F.col("_keep._id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_keep._row")).alias("kept"),
        "_with",
    )
    alone = rows.filter("_full is null").select(
        "_id",
        F.col("_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        "_with",
    )
    names = [c for c in rows.schema["_with"].dataType.names[1:]]
    return shared.unionByName(alone).select(
        F.col("_id").alias(id_col),
        "keep_id",
        "group_size",
        "kept",
        *(F.col("_with")[c].alias(c) for c in names),
    )


def _marked(rows: DataFrame, key: Column, name: str, otherwise: Column) -> DataFrame:
    """Rows with ``name``: may the key occur again? ``otherwise`` if too many do for a filter."""
    marked = with_repeated(rows, key, name)
    return rows.withColumn(name, otherwise) if marked is None else marked


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; see ``exact_duplicates``."""
    carried = [F.col(f"`{c}`") for c in docs.columns if c != id_col]
    kept = exact_duplicates(
        docs, id_col, text_col, [F.struct(*carried).alias("_columns")]
    ).filter("kept")
    return kept.select(
        *(F.col(id_col) if c == id_col else F.col("_columns")[c].alias(c) for c in docs.columns)
    )
