"""SimHash near-duplicates: fingerprints, a grid join on segment bit counts, and components.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints. Two
fingerprints that differ in three bits or fewer are, on one half of the segments, at
Manhattan distance one or less; so each half is a grid of unit cells in which a
fingerprint lies in its own cell and looks into those one step up. Rows that meet in a
cell are compared by the Manhattan bound and then bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbundle.llm.common import bounded_batches, durable_table, spread_join, text_of
from corpusbundle.llm.components import components
from corpusbundle.llm.spans import lowered, ragged, runs, words

#: Bits in which linked fingerprints may differ. The grid below is made for three.
RADIUS = 3

#: A cell with more rows than this is compared in blocks, in tasks of their own.
CELL_ROWS = 1 << 16

#: Up to so many rows of a cell give all their links; beyond, a spanning forest of them.
FEW = 16

_LOW = np.uint64(0x5555555555555555)


# Fingerprints.


def fingerprints_of(column: pa.Array, width: int = 3) -> np.ndarray:
    """Unsigned 64-bit fingerprint of each text."""
    found = [np.zeros(0, np.uint64)]
    digest = xxhash.xxh64_intdigest
    for texts in runs(column):
        texts = lowered(texts)
        spans = words(texts)
        n_words = np.diff(spans.at)
        # All words, each with one space after it.
        length = spans.end - spans.start + 1
        padded = np.append(texts.data, np.uint8(32))
        flat = padded[ragged(spans.start, length)]
        after = np.cumsum(length)
        flat[after - 1] = 32
        raw = flat.tobytes()
        # A text of fewer words than a shingle is one shingle.
        n_shingles = np.where(n_words > 0, np.maximum(n_words - width + 1, 1), 0)
        first = ragged(spans.at[:-1], n_shingles)
        last = first + np.repeat(np.minimum(width, n_words) - 1, n_shingles)
        begin, end = (after - length)[first].tolist(), (after[last] - 1).tolist()
        h = np.fromiter((digest(raw[a:b], 42) for a, b in zip(begin, end)), np.uint64, len(begin))
        found.append(_majorities(h, np.concatenate([[0], np.cumsum(n_shingles)])))
    return np.concatenate(found)


def _majorities(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each range of hashes, the bits that are set in more than half of them."""
    # Lanes of 16 bits hold counts up to 65,535, so longer ranges are summed in stretches.
    stretch = np.unique(np.concatenate([at, np.arange(0, len(h), 65_535)]))
    owner = np.searchsorted(at, stretch[:-1], side="right") - 1
    half = np.diff(at)
    result = np.zeros(len(at) - 1, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    for low in range(16):
        np.cumsum(h >> np.uint64(low) & np.uint64(0x0001000100010001), out=total[1:])
        lanes = total[stretch[1:]] - total[stretch[:-1]]
        for lane in range(4):
            counts = np.zeros(len(at) - 1, np.int64)
            np.add.at(counts, owner, (lanes >> np.uint64(16 * lane) & np.uint64(0xFFFF)).astype(np.int64))
            result |= (counts * 2 > half).astype(np.uint64) << np.uint64(low + 16 * lane)
    return result


# The grid.


def bit_counts(fingerprint: np.ndarray) -> np.ndarray:
    """The embedding: each two-bit segment's count in unary (00, 01, 11), so that the
    Manhattan distance of two embeddings is the number of bits in which they differ."""
    other = fingerprint >> np.uint64(1)
    return ((fingerprint | other) & _LOW) | ((fingerprint & other & _LOW) << np.uint64(1))


def grid_rows(fingerprint: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell, index of the fingerprint, whether it is its own cell), over both halves."""
    counts = bit_counts(fingerprint)
    cells, index, home = [], [], []
    everyone = np.arange(len(fingerprint))
    for half in range(2):
        own = (counts >> np.uint64(32 * half) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        side = half << 32
        cells.append(own | side)
        index.append(everyone)
        home.append(np.ones(len(own), bool))
        for segment in range(16):
            count = own >> 2 * segment & 3
            can = np.flatnonzero(count < 3)
            step = np.where(count[can] == 0, 1, 2) << 2 * segment
            cells.append((own[can] | step) | side)
            index.append(can)
            home.append(np.zeros(len(can), bool))
    return np.concatenate(cells), np.concatenate(index), np.concatenate(home)


def _linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The Manhattan bound first, then the exact Hamming distance of what passes it."""
    near = np.bitwise_count(bit_counts(a) ^ bit_counts(b)) <= RADIUS
    near[near] = np.bitwise_count(a[near] ^ b[near]) <= RADIUS
    return near


def _links(cell: np.ndarray, fp: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links among rows sorted by cell."""
    edges = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    size = np.diff(edges)
    # Short runs: each row with the k-th after it, for all runs at once.
    few = size <= FEW
    left = np.repeat(np.where(few, edges[1:], 0), size) - np.arange(len(cell))
    row = np.flatnonzero(left > 1)
    for k in range(1, FEW):
        row = row[left[row] > k]
        if not len(row):
            break
        pair = row[(home[row] | home[row + k]) & (fp[row] != fp[row + k])]
        hit = pair[_linked(fp[pair], fp[pair + k])]
        yield fp[hit], fp[hit + k]
    for i in np.flatnonzero(~few):
        yield from _forest(fp[edges[i] : edges[i + 1]], home[edges[i] : edges[i + 1]])


def _forest(fp: np.ndarray, home: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links in one cell, breadth first; each row is reached once."""
    rest = np.arange(len(fp))
    while len(rest):
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            now, frontier = frontier[:128], frontier[128:]
            a = np.repeat(now, len(rest))
            b = np.tile(rest, len(now))
            near = (_linked(fp[a], fp[b]) & (home[a] | home[b])).reshape(len(now), len(rest))
            hit = near.any(axis=0)
            yield fp[now[near[:, hit].argmax(axis=0)]], fp[rest[hit]]
            frontier, rest = np.concatenate([frontier, rest[hit]]), rest[~hit]


def _pairs_task(most: int):
    """Links of a partition sorted by cell; the rows of a cell beyond ``most`` are handed on."""

    def out(kind: int, cell, a, b, home) -> pa.RecordBatch:
        n = len(a)
        arrays = [np.full(n, kind, np.int32), np.broadcast_to(cell, n), a, b, np.broadcast_to(home, n)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(x)) for x in arrays], ["kind", "cell", "a", "b", "home"]
        )

    def found(rows):
        for a, b in _links(rows[0], rows[1], rows[2]):
            if len(a):
                yield out(0, 0, a.view(np.int64), b.view(np.int64), False)

    def deferred(rows):
        f = rows[1].view(np.int64)
        yield out(1, rows[0], f, f, rows[2])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, crowded = None, None  # the rows of the last cell so far; a cell known to be too large
        for batch in batches:
            new = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            new[1] = new[1].view(np.uint64)
            rows = new if held is None else [np.concatenate(x) for x in zip(held, new)]
            if not len(rows[0]):
                continue
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            done, held = [x[:cut] for x in rows], [x[cut:] for x in rows]
            if crowded is not None:
                own = int(np.searchsorted(done[0], crowded, side="right"))
                if own:
                    yield from deferred([x[:own] for x in done])
                    done = [x[own:] for x in done]
                if held[0][0] != crowded:
                    crowded = None
            edges = np.flatnonzero(np.concatenate([[True], done[0][1:] != done[0][:-1]])) if cut else []
            sizes = np.diff(np.append(edges, len(done[0]))) if len(done[0]) else np.zeros(0, np.int64)
            if len(sizes) and sizes.max() > most:
                over = np.repeat(sizes > most, sizes)
                yield from deferred([x[over] for x in done])
                done = [x[~over] for x in done]
            if len(done[0]):
                yield from found(done)
            if crowded is not None or len(held[0]) > most:
                crowded = held[0][0]
                yield from deferred(held)
                held = None
        if held is not None and len(held[0]):
            yield from deferred(held) if held[0][0] == crowded else found(held)

    return task


_FOUND = "kind int, cell long, a long, b long, home boolean"


def links(prints: DataFrame, most: int = CELL_ROWS) -> DataFrame:
    """Links (a, b) that join all fingerprints within the radius; ``prints`` has distinct ``fp`` longs.

    Where many near fingerprints share a cell the links of the cell are thinned to a
    spanning forest, so components are kept and their size is linear.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fp), 1 << 16):
                part = fp[at : at + (1 << 16)]
                cell, index, home = grid_rows(part.view(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell), pa.array(part[index]), pa.array(home)], ["cell", "fp", "home"]
                )

    def meet(rows: DataFrame, limit: int) -> DataFrame:
        return rows.repartition("cell").sortWithinPartitions("cell").mapInArrow(_pairs_task(limit), _FOUND)

    rows = prints.select("fp").mapInArrow(spread, "cell long, fp long, home boolean")
    first = durable_table(meet(rows, most))
    crowded = first.filter("kind = 1").select("cell", F.col("a").alias("fp"), "home")
    blocks = durable_table(
        crowded.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / most).alias("_blocks"), F.count(F.lit(1)).alias("_n"))
    )
    found = first.filter("kind = 0").select("a", "b")
    if blocks.isEmpty():
        return found.distinct()
    # Every two blocks of a crowded cell meet in a cell of their own.
    own = F.pmod(F.xxhash64("fp"), F.col("_blocks"))
    paired = (
        spread_join(crowded, blocks, "cell", "_n")
        .withColumn("_own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
        .select(
            F.xxhash64("cell", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("cell"), "fp", "home"
        )
    )
    more = meet(paired, 1 << 40).select("a", "b")
    return found.unionByName(more).distinct()


# The operator.


def named_classes(rows: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows (_id, fp) with component_id, the smallest id of all values that the links of ``links_of`` join."""
    each = durable_table(rows.groupBy("fp").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_rows")))
    roots = components(links_of(each))
    rooted = durable_table(
        each.join(roots, each.fp == roots.node, "left").select(
            "fp", "_least", "_rows", F.coalesce("root", "fp").alias("root")
        )
    )
    classes = durable_table(
        rooted.groupBy("root").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_prints"))
    )
    named = durable_table(spread_join(rooted, classes, "root", "_prints").select("fp", "_rows", "component_id"))
    return spread_join(rows, named, "fp", "_rows")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3
) -> DataFrame:
    """One row per row of ``docs``: id, fingerprint (16 hex digits), component_id.

    component_id is the smallest id that links reach, the row's own included. A null or
    blank text has fingerprint zero and links like any other. A null id is ignored as a
    component's id unless no row of the component has another. Repeated rows have a row
    each. Other columns are not read; an empty table gives no rows.
    """

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = fingerprints_of(batch.column(1), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["_id", "fp"])

    bounded_batches(docs)
    source = docs.select(F.col(id_col).alias("_id"), text_of(text_col).cast("binary").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    rows = durable_table(source.mapInArrow(prints, f"_id {kind}, fp long"))
    return named_classes(rows, links).select(
        F.col("_id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of their component, with their columns.

    Rows with a null id stay.
    """
    classes = near_duplicates(docs, id_col, text_col)
    dropped = durable_table(
        classes.filter(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_id")).distinct()
    )
    return docs.join(dropped, docs[id_col] == dropped["_id"], "left_anti")
