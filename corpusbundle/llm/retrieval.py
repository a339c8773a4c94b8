"""Ranked lexical search by buckets of vectors in order of length.

A document is a vector of impacts: for each term it shares with the items, the term's weight
times the saturated frequency, all whole numbers. Its score for an item is the product with
the item's vector of term counts. Vectors are placed by range in descending order of length,
and each task takes its range bucket by bucket, holding the best documents found so far for
each item. By Cauchy-Schwarz an item skips a bucket whose longest vector cannot reach the
item's threshold. Inside a bucket the greatest impact of each term bounds what a coordinate can
give: the terms that cannot reach the threshold together are set aside, and only documents
with one of the others are candidates. Their partial score and the length that is left bound
the whole; those that may still reach the threshold are scored exactly.

The longest vectors of all are searched first, so every task starts with a threshold for
each item. A bound is compared strictly, so documents that tie with the threshold are scored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusbundle.llm.common import bounded_batches, durable_table, text_of
from corpusbundle.llm.spans import Texts, distinct, lowered, runs, terms
from corpusbundle.operators.ordering import with_positions

#: Texts of the items that one search takes to all tasks; more items make more searches.
BLOCK_BYTES = 4 << 20

#: Documents and impacts of one bucket, at most (one vector may exceed the second).
BUCKET_ROWS = 4096
BUCKET_IMPACTS = 1 << 20

_MISSING = np.iinfo(np.int64).max
_VECTORS = "_id long, _row long, n long, ids array<int>, counts array<int>"
_FOUND = "_item long, _id long, _row long, score long"


@dataclass(frozen=True)
class Items:
    """The items of one search: ``ids[at[i]:at[i + 1]]`` are the terms of item i, ``times`` their counts."""

    rows: np.ndarray
    at: np.ndarray
    ids: np.ndarray
    times: np.ndarray
    vocabulary: dict[bytes, int]

    @staticmethod
    def of(rows: list[int], texts: list[bytes]) -> Items:
        vocabulary: dict[bytes, int] = {}
        at, ids, times = [0], [], []
        for text in texts:
            counts: dict[int, int] = {}
            for held in runs(pa.array([text], pa.binary())):
                held = lowered(held)
                spans, raw = terms(held), held.data.tobytes()
                for a, b in zip(spans.start.tolist(), spans.end.tolist()):
                    term = vocabulary.setdefault(raw[a:b], len(vocabulary))
                    counts[term] = counts.get(term, 0) + 1
            ids.extend(counts)
            times.extend(counts.values())
            at.append(len(ids))
        as_long = lambda values: np.array(values, dtype=np.int64)
        return Items(as_long(rows), as_long(at), as_long(ids), as_long(times), vocabulary)

    def __len__(self) -> int:
        return len(self.rows)


# Vectors.


def term_counts(texts: Texts, vocabulary: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms of each text, at, ids, counts): ids[at[i]:at[i + 1]] are the known terms of text i, ascending."""
    texts = lowered(texts)
    spans = terms(texts)
    n = np.diff(spans.at)
    codes, first = distinct(texts.data, spans)
    raw = texts.data.tobytes()
    pairs = zip(spans.start[first].tolist(), spans.end[first].tolist())
    known = np.array([vocabulary.get(raw[a:b], -1) for a, b in pairs], dtype=np.int64)
    term = known[codes] if len(codes) else np.zeros(0, np.int64)
    size = max(len(vocabulary), 1)
    key = np.repeat(np.arange(len(texts)), n) * size + term
    key, counts = np.unique(key[term >= 0], return_counts=True)
    return n, np.searchsorted(key, np.arange(len(texts) + 1) * size), key % size, counts


def _lists(at: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(values.astype(np.int32)))


def _vectors(source: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """(_id, _row, n, ids, counts) of the documents that have a term."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in runs(batch.column(2)):
                n, at, ids, counts = term_counts(texts, vocabulary)
                rows = [batch.column(c).slice(texts.first, len(texts)) for c in (0, 1)]
                found = pa.RecordBatch.from_arrays(
                    [*rows, pa.array(n), _lists(at, ids), _lists(at, counts)], ["_id", "_row", "n", "ids", "counts"]
                )
                yield found.filter(pa.array(n > 0))

    return source.mapInArrow(task, _VECTORS)


def weight(n_docs: int, held_by: int) -> int:
    """floor(1000 ln((2 N + 2) / (2 df + 1)))"""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held_by + 1)))


def impacts(counts: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return weights * ((1_000_000_000 * counts) // (1000 * counts + 8 * m))


def _offsets(lists: pa.ListArray) -> np.ndarray:
    return lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()


def _with_lengths(vectors: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Vectors with ``m`` and the ``length`` of their impacts; those without a known term go."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _offsets(batch.column(3))
            ids, counts = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (3, 4))
            m = np.repeat(batch.column(5).to_numpy(), np.diff(at))
            squares = np.square(impacts(counts, m, weights[ids]).astype(np.float64))
            total = np.concatenate([[0.0], np.cumsum(squares)])
            # Rounded up by more than the sums can lose.
            length = np.sqrt(total[at[1:]] - total[at[:-1]] + total[-1] * 1e-12)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(length)], [*batch.schema.names, "length"])

    # 75 n N may pass 64 bits in a very large table.
    share = f"cast(75 * n as decimal(19,0)) * cast('{n_docs}' as decimal(19,0)) div cast('{max(n_terms, 1)}' as decimal(19,0))"
    held = vectors.filter(F.size("ids") > 0).withColumn("m", F.expr(f"25L + ({share})"))
    return held.mapInArrow(task, f"{_VECTORS}, m long, length double")


# Search.


class Bucket:
    """Vectors of similar length, by term."""

    def __init__(self, idents: np.ndarray, rows: np.ndarray, lengths: np.ndarray, at, ids, values, n_ids: int):
        self.idents, self.rows, self.lengths = idents, rows, lengths
        by_term = np.argsort(ids, kind="stable")
        self.at = np.searchsorted(ids[by_term], np.arange(n_ids + 1))
        self.docs = np.repeat(np.arange(len(rows)), np.diff(at))[by_term]
        self.values = values[by_term]
        self.greatest = np.zeros(n_ids, np.int64)
        np.maximum.at(self.greatest, ids, values)

    def column(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.at[term], self.at[term + 1]
        return self.docs[a:b], self.values[a:b]

    def scores(self, ids: np.ndarray, times: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of all that reach ``least`` (1 or more), and perhaps of some that do not."""
        most = times * self.greatest[ids]
        order = np.argsort(most, kind="stable")
        reach = np.cumsum(most[order])
        if not len(reach) or reach[-1] < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        # These terms together do not reach the threshold: a candidate has one of the others.
        aside = int(np.searchsorted(reach, least))
        rest, focus = order[:aside], order[aside:]
        score = np.zeros(len(self.rows), np.int64)
        squares = np.zeros(len(self.rows))
        for k in focus:
            docs, values = self.column(ids[k])
            score[docs] += times[k] * values
            squares[docs] += np.square(values.astype(np.float64))
        docs = np.flatnonzero(score)
        left = np.sqrt(np.maximum(np.square(self.lengths[docs]) * (1 + 1e-9) - squares[docs], 0))
        bound = np.minimum(left * math.sqrt(float(np.square(times[rest]).sum())), reach[aside - 1] if aside else 0)
        docs = docs[score[docs] + bound * (1 + 1e-9) >= least]
        found = score[docs]
        for k in rest:
            held, values = self.column(ids[k])
            if len(held):
                place = np.minimum(np.searchsorted(held, docs), len(held) - 1)
                found += np.where(held[place] == docs, times[k] * values[place], 0)
        return docs, found


class Search:
    """The best documents so far for each item of a block."""

    def __init__(self, items: Items, weights: np.ndarray, top: int, least: np.ndarray):
        self.items, self.weights, self.top = items, weights, top
        self.least = least.copy()
        self.best = [np.zeros((3, 0), np.int64) for _ in range(len(items))]
        squares = np.concatenate([[0], np.cumsum(np.square(items.times))])
        self.lengths = np.sqrt(squares[items.at[1:]] - squares[items.at[:-1]])

    def take(self, bucket: Bucket) -> None:
        items = self.items
        for i in np.flatnonzero(self.lengths * bucket.lengths.max() * (1 + 1e-9) >= self.least):
            span = slice(items.at[i], items.at[i + 1])
            docs, scores = bucket.scores(items.ids[span], items.times[span], max(int(self.least[i]), 1))
            good = scores >= max(int(self.least[i]), 1)
            if not good.any():
                continue
            docs, scores = docs[good], scores[good]
            found = np.concatenate([self.best[i], [scores, bucket.idents[docs], bucket.rows[docs]]], axis=1)
            kept = found[:, np.lexsort((found[2], found[1], -found[0]))[: self.top]]
            self.best[i] = kept
            if kept.shape[1] == self.top:
                self.least[i] = max(self.least[i], kept[0, -1])

    def batch(self) -> pa.RecordBatch:
        sizes = [b.shape[1] for b in self.best]
        score, ident, row = np.concatenate([np.zeros((3, 0), np.int64), *self.best], axis=1)
        held = pa.array(ident, mask=ident == _MISSING)
        item = pa.array(np.repeat(self.items.rows, sizes))
        return pa.RecordBatch.from_arrays([item, held, pa.array(row), pa.array(score)], ["_item", "_id", "_row", "score"])


def _buckets(batches: Iterator[pa.RecordBatch], weights: np.ndarray) -> Iterator[Bucket]:
    for batch in batches:
        at = _offsets(batch.column(3))
        ids, counts = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (3, 4))
        values = impacts(counts, np.repeat(batch.column(5).to_numpy(), np.diff(at)), weights[ids])
        idents = batch.column(0).fill_null(_MISSING).to_numpy()
        rows, lengths = batch.column(1).to_numpy(), batch.column(6).to_numpy()
        row = 0
        while row < batch.num_rows:
            end = int(np.searchsorted(at, at[row] + BUCKET_IMPACTS, side="right")) - 1
            end = min(max(end, row + 1), row + BUCKET_ROWS, batch.num_rows)
            part, span = slice(row, end), slice(at[row], at[end])
            yield Bucket(idents[part], rows[part], lengths[part], at[row : end + 1], ids[span], values[span], len(weights))
            row = end


def _searched(vectors: DataFrame, items: Items, weights: np.ndarray, top: int, least: np.ndarray) -> DataFrame:
    """The best documents of each task for each item; the vectors of a task come in descending order of length."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(items, weights, top, least)
        for bucket in _buckets(batches, weights):
            search.take(bucket)
        yield search.batch()

    return vectors.mapInArrow(task, _FOUND)


def _best(found: DataFrame, top: int) -> DataFrame:
    """A task gives an item no more than ``top`` rows, so an item has few."""
    order = Window.partitionBy("_item").orderBy(F.desc("score"), F.asc_nulls_last("_id"), "_row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def _block(source: DataFrame, items: Items, top: int) -> DataFrame | None:
    vectors = durable_table(_vectors(source, items.vocabulary))
    n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
    if not n_docs or not items.vocabulary:
        return None
    held_by = np.zeros(len(items.vocabulary), np.int64)
    # One row for each term of the block.
    for term, n in vectors.select(F.explode("ids").alias("t")).groupBy("t").count().collect():
        held_by[term] = n
    weights = np.array([weight(n_docs, n) for n in held_by.tolist()], dtype=np.int64)
    order = [F.desc("length"), F.asc("_row")]
    ready = durable_table(_with_lengths(vectors, weights, n_docs, n_terms))
    longest = ready.orderBy(*order).limit(BUCKET_ROWS)
    none = np.zeros(len(items), np.int64)
    first = _best(_searched(longest, items, weights, top, none), top).filter(F.col("rank") == top)
    least = dict(first.select("_item", "score").collect())
    start = np.array([least.get(i, 0) for i in items.rows.tolist()], dtype=np.int64)
    ranges = ready.repartitionByRange(*order).sortWithinPartitions(*order)
    return durable_table(_best(_searched(ranges, items, weights, top, start), top))


def search(
    docs: DataFrame,
    items: DataFrame,
    top: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0.

    Equal scores go by ascending id, a null id last, rows of one id in any order. Ids of
    documents are whole numbers, those of items of any type; each row of ``items`` is an item,
    also where rows are equal. A null text has no terms: such an item has no rows, and such
    a document is never found and not counted. Other columns are not read. Empty tables
    give no rows. All documents are searched, once for each ``block_bytes`` of item texts.
    """
    bounded_batches(docs)
    source = docs.select(
        F.col(id_col).cast("long").alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
        text_of(text_col).cast("binary").alias("_text"),
    )
    named = durable_table(
        items.select(
            F.monotonically_increasing_id().alias("_item"),
            F.col(item_col).alias("_name"),
            text_of(item_text).cast("binary").alias("_text"),
        )
    )
    sized = named.select("_item", F.octet_length("_text").cast("long").alias("_size"))
    placed = with_positions(sized, [], ["_item"], "_size").select(
        "_item", F.expr(f"byte_offset div {int(block_bytes)}").alias("_block")
    )
    blocks = durable_table(placed)
    found = [docs.sparkSession.createDataFrame([], f"{_FOUND}, rank int")]
    for (block,) in blocks.select("_block").distinct().orderBy("_block").collect():
        # One block, or one item that is larger.
        held = named.join(blocks.filter(F.col("_block") == block), "_item").orderBy("_item").collect()
        part = _block(source, Items.of([r["_item"] for r in held], [bytes(r["_text"]) for r in held]), top)
        if part is not None:
            found.append(part)
    ranked = found[0]
    for part in found[1:]:
        ranked = ranked.unionByName(part)
    return ranked.join(named.select("_item", "_name"), "_item").select(
        F.col("_name").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("_id").alias(id_col), "score"
    )
