"""Positions and running values in a total order, without one task per group.

A plain window over a group sorts the whole group in one task, which fails when
one project, site or host holds a large share of all rows (or when there is no
key at all). Here the rows are range-partitioned on (keys, order), so even one
hot key is cut into contiguous slices of similar row counts. Work inside a slice
is a window keyed by (keys, slice); what earlier slices contribute comes from
one small row per (key, slice).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from corpusbundle.operators.durable import durable

SLICE = "_slice"


def slice_by_order(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], slices: int | None = None
) -> DataFrame:
    """Add ``_slice``: within a key, every row of a slice sorts before the next slice.

    Rows with equal (keys, order) share a slice, so ``order`` should tell them apart.
    Pass narrow rows only. The result is checkpointed, because slice numbers depend
    on sampled boundaries.
    """
    by = [*keys, *order]
    ranged = df.repartitionByRange(*([slices] if slices else []), *by)
    return durable(ranged.withColumn(SLICE, F.spark_partition_id()))


def within_slice(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, SLICE).orderBy(*order)


def earlier_slices(keys: Sequence[str]) -> WindowSpec:
    """Rows of one key hold one entry per slice here, so this window stays small."""
    return (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(SLICE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )


def join_slices(rows: DataFrame, starts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring per-slice values back to the rows of the slice; null keys match too."""
    on = [*keys, SLICE]
    renamed = reduce(lambda df, c: df.withColumnRenamed(c, f"_start_{c}"), on, starts)
    same = reduce(
        lambda a, b: a & b, (rows[c].eqNullSafe(renamed[f"_start_{c}"]) for c in on)
    )
    return rows.join(renamed, same).drop(*(f"_start_{c}" for c in on))


def with_positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    nbytes: str | None = None,
    keep_key_if: str | None = None,
    slices: int | None = None,
    keep_slice: bool = False,
) -> DataFrame:
    """Add ``ordinal`` (from 0) and, given a size column, ``byte_offset`` within each key.

    With ``keep_slice`` the slice of each row is kept: slices follow the order of (keys, order).

    ``order`` must tell the rows of a key apart; the job fails if two are equal.
    ``keep_key_if`` names a boolean column: keys for which it never holds are left out.
    """
    sliced = slice_by_order(df, keys, order, slices)
    within = within_slice(keys, order)
    before = within.rowsBetween(Window.unboundedPreceding, -1)
    earlier = earlier_slices(keys)
    zero = F.lit(0).cast("long")

    def sums(size: Column, over: WindowSpec) -> Column:
        return F.coalesce(F.sum(size).over(over), zero)

    measures = [F.count(F.lit(1)).alias("_n")]
    starts = [*keys, SLICE, sums(F.col("_n"), earlier).alias("_n0")]
    place = F.row_number().over(within)
    clash = F.raise_error(
        F.concat(F.lit("rows of one document share their place: "), F.to_json(F.struct(*order)))
    )
    # A row ranks below its number only if it ties with the row before it.
    shared = F.rank().over(within) < place
    added = {"_at": F.when(shared, clash.cast("long")).otherwise((place - 1).cast("long"))}
    result = {"ordinal": F.col("_n0") + F.col("_at")}
    if nbytes is not None:
        measures.append(F.sum(nbytes).alias("_b"))
        starts.append(sums(F.col("_b"), earlier).alias("_b0"))
        added["_byte_at"] = sums(F.col(nbytes), before)
        result["byte_offset"] = F.col("_b0") + F.col("_byte_at")
    if keep_key_if is not None:
        every = earlier.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        measures.append(F.bool_or(keep_key_if).alias("_any"))
        starts.append(F.bool_or("_any").over(every).alias("_keep"))

    totals = sliced.groupBy(*keys, SLICE).agg(*measures).select(*starts)
    if keep_key_if is not None:
        totals = totals.filter("_keep")
    placed = join_slices(sliced.withColumns(added), totals, keys).withColumns(result)
    return placed.select(*df.columns, *result, *([SLICE] if keep_slice else []))
