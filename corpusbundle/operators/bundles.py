"""Ordered string aggregation into documents."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusbundle.functions.text import content_length, non_blank
from corpusbundle.operators.durable import durable, durable_table
from corpusbundle.operators.ordering import SLICE, with_positions

PART_BYTES = 64 * 1024 * 1024

# Small parts are handed on together.
WAITING_BYTES = 4 * 1024 * 1024

# Text of one task when documents are put together, and bounds that a task compares at once.
BIN_BYTES = 1024 * 1024 * 1024
FANOUT = 32


def assign_parts(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    nbytes: str,
    sep: str = "",
    part_bytes: int = PART_BYTES,
    keep_key_if: str | None = None,
    keep_slice: bool = False,
) -> DataFrame:
    """Add ``ordinal``, ``byte_offset`` and ``part_no`` to narrow rows.

    Offsets count a separator before every row but the first. A part is the run
    of rows that start within one window of ``part_bytes``, so it holds at most
    that many bytes plus one row, however large the document is.
    """
    gap = len(sep.encode())
    sized = rows.withColumn(nbytes, F.col(nbytes) + gap)
    placed = with_positions(sized, keys, order, nbytes, keep_key_if, keep_slice=keep_slice)
    return placed.withColumns(
        {
            nbytes: F.col(nbytes) - gap,
            "byte_offset": F.greatest(F.col("byte_offset") - gap, F.lit(0)),
        }
    ).withColumn("part_no", F.expr(f"byte_offset div {int(part_bytes)}"))


def assembled(part_bytes: int, keys: Sequence[str] = ()):
    """A job that joins consecutive rows of one part into pieces of text.

    Rows (keys, part_no, byte_offset, text, is_start) come in document order, all rows of a
    part in one partition. Memory holds one piece: a part is one piece unless a row of it
    is much larger than ``part_bytes``. Rows without text are left out.
    """
    place = [*keys, "part_no"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, piece, offset, n, size = None, 0, 0, 0, 0
        texts: list[str] = []
        done: list[tuple] = []
        waiting, schema = 0, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

        for batch in batches:
            if schema is None:
                numbers = [pa.field(c, pa.int64()) for c in ("piece_no", "n_sections", "byte_offset")]
                schema = pa.schema([*(batch.schema.field(c) for c in place), *numbers, batch.schema.field("text")])
            columns = [batch.column(c).to_pylist() for c in [*place, "byte_offset", "text", "is_start"]]
            for *key, at, text, start in zip(*columns):
                if text is None:
                    continue
                if texts and (key != now or size >= part_bytes * 2):
                    done.append((*now, piece, n, offset, "".join(texts)))
                    waiting += size
                    piece = piece + 1 if key == now else 0
                    texts, n, size = [], 0, 0
                    if waiting >= WAITING_BYTES:
                        yield out()
                        done, waiting = [], 0
                if not texts:
                    offset = at
                now = key
                texts.append(text)
                size += len(text)
                n += int(start)
        if texts:
            done.append((*now, piece, n, offset, "".join(texts)))
        if done:
            yield out()

    return run


def _bounds(parts: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(_bin, _first, _offset): where each run of whole parts begins, in the order of (keys, order).

    ``parts`` has the slices of its rows. A run is the parts that begin in one slice, or fewer
    if they have more than ``BIN_BYTES``; so there are few runs whatever the number of rows.
    """
    by = [*keys, "part_no"]
    starts = parts.groupBy(*by).agg(
        F.min(F.struct(*order)).alias("_order"),
        F.min("byte_offset").alias("_offset"),
        F.sum("_nbytes").alias("_nbytes"),
        F.min(SLICE).alias(SLICE),
        # Asked for here, because numbering the rows fails where two share a place.
        F.max("ordinal").alias("_last"),
    )
    before = Window.partitionBy(SLICE).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum("_nbytes").over(before), F.lit(0))
    own = F.struct(F.col(SLICE), F.floor(at / BIN_BYTES).alias("_at")).alias("_run")
    # The first part of a run begins it: it has the smallest place.
    first = F.struct(*keys, *(F.col("_order")[c].alias(c) for c in order)).alias("_first")
    runs = starts.select(own, first, "_offset", "_last").groupBy("_run").agg(
        F.min("_first").alias("_first"), F.min_by("_offset", "_first").alias("_offset"), F.max("_last").alias("_last")
    )
    number = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_run")) - 1
    return durable(runs.select(number.cast("long").alias("_bin"), "_first", "_offset", "_last"))


def with_bins(rows: DataFrame, place: Column, bounds: DataFrame, n: int) -> DataFrame:
    """Add ``_bin`` and ``_offset`` of the last of ``n`` bounds (_bin, _first, _offset) not after the row's place.

    Bins are numbered from 0 in the order of ``_first``, and no row lies before bin 0. They
    are looked up as in a tree: each level is a small table that is joined by broadcast and
    has ``FANOUT`` bounds in a row, so a row compares its place with few of them.
    """
    depth = 1
    while FANOUT**depth < n:
        depth += 1
    # The root is 0, worked out from the row, so that its join stays one by key.
    found = rows.withColumn("_place", place).withColumn("_bin", F.pmod(F.xxhash64("_place"), F.lit(1)))
    for level in reversed(range(depth)):
        held = bounds.filter(F.col("_bin") % FANOUT**level == 0)
        entry = F.struct(F.expr(f"_bin div {FANOUT**level}").alias("_bin"), "_first", "_offset")
        nodes = held.groupBy(F.expr(f"_bin div {FANOUT ** (level + 1)}").alias("_node")).agg(
            F.sort_array(F.collect_list(entry)).alias("_entries")
        )
        last = F.element_at(F.filter("_entries", lambda e: e["_first"] <= F.col("_place")), -1)
        found = (
            found.join(F.broadcast(nodes), F.col("_bin") == F.col("_node"))
            .withColumn("_entry", last)
            .drop("_node", "_entries", "_bin", "_offset")
            .select("*", "_entry._bin", "_entry._offset")
            .drop("_entry")
        )
    return found.drop("_place")


def _parts_task(keys: Sequence[str], sep: str, part_bytes: int):
    """A job that joins consecutive rows (keys, _bin, _offset, text) of one document into its parts.

    ``_offset`` is where the first row of a bin begins in its document. Memory holds one part.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, bin_, part, offset, begin = None, None, 0, 0, 0
        texts: list[str] = []
        done: list[tuple] = []
        waiting, schema, gap = 0, None, len(sep.encode())

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), schema)], schema=schema)

        for batch in batches:
            if schema is None:
                numbers = [pa.field(c, pa.int64()) for c in ("part_no", "n_sections", "byte_offset")]
                schema = pa.schema([*(batch.schema.field(c) for c in keys), *numbers, batch.schema.field("text")])
            columns = [batch.column(c).to_pylist() for c in (*keys, "_bin", "_offset", "text")]
            sizes = pc.binary_length(batch.column("text")).to_pylist()
            for (*key, own, start, text), size in zip(zip(*columns), sizes):
                if own != bin_:
                    # A run begins a document, or goes on with one at the start of a later part.
                    first, offset_of = start == 0, start
                elif key != now:
                    first, offset_of = True, 0
                else:
                    first, offset_of = False, offset
                new_part = offset_of // part_bytes
                if texts and (key != now or own != bin_ or new_part != part):
                    done.append((*now, part, len(texts), begin, "".join(texts)))
                    texts = []
                    if waiting >= WAITING_BYTES:
                        yield out()
                        done, waiting = [], 0
                if not texts:
                    begin, part = offset_of, new_part
                now, bin_ = key, own
                texts.append(text if first else sep + text)
                offset = offset_of + size + (0 if first else gap)
                waiting += size
        if texts:
            done.append((*now, part, len(texts), begin, "".join(texts)))
        if done:
            yield out()

    return run


def bundle_parts(
    sections: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    text: str,
    sep: str = "",
    part_bytes: int = PART_BYTES,
    skip_blank: bool = False,
) -> DataFrame:
    """One document per key as rows (keys, part_no, n_sections, byte_offset, text).

    ``order`` must tell the rows of a key apart (see ``keep_last``). A document no
    larger than ``part_bytes`` is one row. ``skip_blank`` leaves out documents
    that hold nothing but white space. Rows without text are left out.

    Order and part numbers are worked out on a narrow table, written once, and the parts are
    dealt to runs of about equal bytes. The text is read a second time and shuffled once: each
    row finds its run by its place, and a run's rows are sorted and joined as they pass. What
    offset a run begins at is known beforehand, so a document may span many runs.
    """
    sections = sections.filter(F.col(text).isNotNull())
    narrow = durable_table(
        sections.select(
            *keys,
            *order,
            content_length(F.col(text)).alias("_nbytes"),
            *([non_blank(F.col(text)).alias("_has_text")] if skip_blank else []),
        )
    )
    schema = T.StructType(
        [*(sections.schema[k] for k in keys)]
        + [T.StructField(c, T.LongType()) for c in ("part_no", "n_sections", "byte_offset")]
        + [T.StructField("text", T.StringType())]
    )
    if skip_blank:
        sections = _without_blank(sections, narrow, keys)
    has_text = "_has_text" if skip_blank else None
    parts = assign_parts(narrow, keys, order, "_nbytes", sep, part_bytes, has_text, keep_slice=True)
    bounds = _bounds(parts, keys, order)
    bins = bounds.count()
    if not bins:
        return sections.sparkSession.createDataFrame([], schema)
    rows = sections.select(*keys, *order, F.col(text).alias("_text"))
    placed = with_bins(rows, F.struct(*keys, *order), bounds, bins)
    return (
        placed.repartitionById(bins, F.col("_bin").cast("int"))
        .sortWithinPartitions("_bin", *keys, *order)
        .select(*keys, "_bin", "_offset", F.col("_text").alias("text"))
        .mapInArrow(_parts_task(list(keys), sep, part_bytes), schema)
    )


def _without_blank(sections: DataFrame, narrow: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sections of documents that hold some text; few documents are blank, so those are joined."""
    blank = durable(narrow.groupBy(F.struct(*keys).alias("_blank")).agg(F.max("_has_text").alias("_any")).filter("not _any"))
    if blank.isEmpty():
        return sections
    # Structs are equal where their nulls are.
    return sections.join(blank.select("_blank"), F.struct(*(sections[k] for k in keys)) == F.col("_blank"), "left_anti")


def union_sections(*parts: DataFrame) -> DataFrame:
    """All sections of several sources as one table; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
