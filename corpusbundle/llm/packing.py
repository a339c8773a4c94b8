"""Packing token runs into sequences by minimum bin slack.

A document longer than a sequence gives whole sequences first; what remains is a
length below the capacity. There are fewer such lengths than the capacity, whatever
the corpus holds, so the packing is planned on their counts alone: the longest length
left opens a window, a bitset subset-sum picks the multiset that fills the rest of it
closest to capacity, and the same filling is used as often as the counts allow. Tasks
then place their own documents by their rank within a length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusbundle.llm.common import bounded_batches, durable_table, text_of
from corpusbundle.llm.spans import ragged
from corpusbundle.llm.vocabulary import Vocabulary


def best_filling(counts: dict[int, int], room: int) -> tuple[int, dict[int, int]]:
    """(sum, multiset) of the lengths whose sum comes closest to ``room`` without exceeding it.

    Bit s of ``reach`` tells that some multiset sums to s. Counts enter as powers of two,
    longest lengths first; the walk back through the stages gives how often each is used.
    """
    full, mask, reach = 1 << room, (2 << room) - 1, 1
    stages = []
    for length in sorted((c for c in counts if c <= room and counts[c] > 0), reverse=True):
        left, copies = min(counts[length], room // length), 1
        while left > 0 and not reach & full:
            used = min(copies, left)
            stages.append((length, used, reach))
            reach |= (reach << length * used) & mask
            left, copies = left - used, copies * 2
        if reach & full:
            break
    best = at = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, used, before in reversed(stages):
        if not before >> at & 1:
            at -= length * used
            chosen[length] = chosen.get(length, 0) + used
    return best, chosen


@dataclass
class Plan:
    """Where the documents of each remaining length go, by rank; one entry per length and filling."""

    length: np.ndarray
    rank: np.ndarray
    copies: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int


def plan_windows(counts: dict[int, int], capacity: int) -> Plan:
    """Fill windows until no length is left. Each filling uses up one length at least."""
    left = {c: n for c, n in counts.items() if n > 0}
    taken = dict.fromkeys(left, 0)
    rows, sequences = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        _, chosen = best_filling(left, capacity - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[c] // n for c, n in chosen.items())
        at = 0
        for length, n in sorted(chosen.items(), reverse=True):
            rows.append((length, taken[length], n, sequences, at))
            at += length * n
            taken[length] += n * times
            left[length] -= n * times
            if not left[length]:
                del left[length]
        sequences += times
    rows.sort()
    columns = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences)


def pack(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then ``end_id``. It is cut only where a sequence is full;
    such sequences have no other piece. Padding is left in windows that no remaining
    length can fill, the last ones of a corpus. A null text is empty: its only id is
    ``end_id``. Repeated rows are packed each; a null id stays null. Sequence ids are
    distinct but have gaps. Other columns are not read; an empty table gives no rows.
    """
    bounded_batches(docs)
    vocabulary = Vocabulary(tokenizer)
    edge = capacity

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        encoder, seen, wholes = vocabulary.encoder(), np.zeros(edge, np.int64), 0
        for batch in batches:
            n_tokens, crcs = [], []
            for ids, at in encoder.texts(batch.column(1)):
                for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                    own = np.append(ids[a:b], end_id).astype("<u4")
                    n_tokens.append(len(own))
                    crcs.append([zlib.crc32(own[k : k + edge].tobytes()) for k in range(0, len(own), edge)])
            n = np.array(n_tokens, dtype=np.int64)
            remainder, whole = n % edge, n // edge
            # Rank among the rows of this task that have the same remainder, in scan order.
            order = np.argsort(remainder, kind="stable")
            sorted_r = remainder[order]
            first = np.searchsorted(sorted_r, sorted_r)
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - first
            rank += seen[remainder]
            seen += np.bincount(remainder, minlength=edge)
            before = wholes + np.cumsum(whole) - whole
            wholes += int(whole.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(np.full(len(n), task, np.int64)), pa.array(n), pa.array(remainder),
                    pa.array(rank), pa.array(before), pa.array(crcs, pa.list_(pa.int64())),
                ],
                ["_id", "_task", "_n", "_rest", "_rank", "_wholes", "_crcs"],
            )

    source = docs.select(F.col(id_col).alias("_id"), text_of(text_col).cast("binary").alias("_text"))
    kind = source.schema["_id"].dataType.simpleString()
    rows = durable_table(
        source.mapInArrow(
            tokenised,
            f"_id {kind}, _task long, _n long, _rest long, _rank long, _wholes long, _crcs array<long>",
        )
    )
    per_task = durable_table(
        rows.filter("_rest > 0").groupBy("_task", "_rest").agg(F.count(F.lit(1)).alias("_count"))
    )
    # Fewer rows than the capacity, at every size of the corpus.
    counts = {r._rest: r._n for r in per_task.groupBy("_rest").agg(F.sum("_count").alias("_n")).collect()}
    plan = plan_windows(counts, capacity)

    earlier = Window.partitionBy("_rest").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_task.select(
        "_task", "_rest", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).cast("long").alias("_from")
    )

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _pieces(batch, plan, edge)

    located = rows.join(starts, ["_task", "_rest"], "left").select(
        "_id", "_task", "_n", "_rest", (F.col("_rank") + F.coalesce("_from", F.lit(0))).alias("_rank"),
        "_wholes", "_crcs",
    )
    result = (
        "_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
    return located.mapInArrow(placed, result.format(kind)).withColumnRenamed("_id", id_col)


def _pieces(batch: pa.RecordBatch, plan: Plan, capacity: int) -> pa.RecordBatch:
    task, n, rest, rank, wholes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
    per_doc = -(-n // capacity)
    row = np.repeat(np.arange(len(n)), per_doc)
    start = ragged(np.zeros(len(n), np.int64), per_doc) * capacity
    length = np.minimum(n[row] - start, capacity)
    # Sequences of one piece are numbered by task, beyond those of the plan.
    sequence = plan.sequences + (task[row] << 33) + wholes[row] + start // capacity
    offset = np.zeros(len(row), np.int64)
    last = np.flatnonzero(length < capacity)
    if len(last):
        r, q = rest[row[last]], rank[row[last]]
        # The last entry of this length that begins at or below the rank.
        keys = plan.length * (1 << 40) + plan.rank
        entry = np.searchsorted(keys, r * (1 << 40) + q, side="right") - 1
        nth = q - plan.rank[entry]
        sequence[last] = plan.sequence[entry] + nth // plan.copies[entry]
        offset[last] = plan.offset[entry] + nth % plan.copies[entry] * r
    columns = [
        batch.column(0).take(pa.array(row)), start, length, batch.column(6).flatten(), n[row], sequence, offset,
    ]
    names = ["_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)
