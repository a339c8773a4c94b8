"""Substring deduplication of word windows by super-k-mers.

A minimiser is the word m-gram with the smallest hash in a window. Consecutive windows
with one minimiser travel as one packed string to the minimiser's bucket, where all
windows are sorted and compared.

1. Minimisers are counted over documents. Windows whose minimiser occurs in one document
   only cannot be copies; a bitmap of fixed size leaves them out. A minimiser that very
   many documents share would make one bucket too large, so its windows are dealt out
   singly by their own hash; there are few such minimisers, whatever the corpus.
2. The other windows are packed. Copies of one packed string are settled by a grouped
   minimum over its digest: all documents but the first lose those windows. Of each
   string a run of texts sends one copy to its bucket; of the strings sent most often,
   which are few, only the first document's copies are sent.
3. A bucket sorts its windows by their words and takes the first document of each.
4. What each document loses is gathered by document and cut from its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbundle.llm.common import bounded_batches, durable_table, slot_bitmap, slots, spread_join, text_of
from corpusbundle.llm.spans import Texts, Words, hashes, mixed, ragged, runs, words
from corpusbundle.operators.keys import with_members

#: Words of a minimiser.
GRAM = 5

#: log2 of the bitmap's slots.
BITS = 26

#: Strings of which only the first document's copies are sent: fewer than this, the most frequent.
SETTLED = 1 << 16

#: A bucket task sorts so many bytes of packed strings at once, or one bucket if that is larger.
SORT_BYTES = 4 << 20

#: Windows whose bytes are compared at once.
COMPARED = 1 << 15


class _Windows:
    """The windows of a run of texts, with their minimisers."""

    def __init__(self, texts: Texts, width: int):
        self.spans: Words = words(texts)
        h = hashes(texts.data, self.spans.start, self.spans.end)
        n_words = np.diff(self.spans.at)
        grams = mixed(_rolled(h, GRAM))
        n = np.maximum(n_words - width + 1, 0)
        self.first = ragged(self.spans.at[:-1], n)  # word at which each window starts
        self.text = np.repeat(np.arange(len(n)), n)
        least = grams[self.first] if len(self.first) else np.zeros(0, np.uint64)
        for k in range(1, width - GRAM + 1):
            least = np.minimum(least, grams[self.first + k])
        self.minimiser = least
        self.hash = mixed(_rolled(h, width) + np.uint64(1))[self.first] if len(self.first) else least


def _rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of the ``width`` values from each place on; the last places have none."""
    n = len(h) - width + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return total


def _minimisers(source: DataFrame, width: int) -> DataFrame:
    """(key, low, high, n): each minimiser with its first and last document, and in how many rows."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for texts in runs(batch.column(1)):
                w = _Windows(texts, width)
                change = np.ones(len(w.minimiser), dtype=bool)
                change[1:] = (w.minimiser[1:] != w.minimiser[:-1]) | (w.text[1:] != w.text[:-1])
                key = w.minimiser[change].view(np.int64)
                own = doc[texts.first + w.text[change]]
                # One row for each minimiser of the run, with its range of documents.
                order = np.lexsort((own, key))
                key, own = key[order], own[order]
                at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
                end = np.append(at[1:], len(key)) if len(key) else at
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key[at]), pa.array(own[at]), pa.array(own[end - 1]), pa.array(end - at)],
                    ["key", "low", "high", "n"],
                )

    rows = source.select("_doc", "_text").mapInArrow(task, "key long, low long, high long, n long")
    return rows.groupBy("key").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))


def _bitmap(spark: SparkSession, keys: DataFrame) -> np.ndarray:
    """One bit per slot, set for the slots of the keys. Its size does not depend on the input."""
    held = np.zeros(1 << (BITS - 6), dtype=np.int64)
    for row in slot_bitmap(F.col("key"), keys, bits=BITS).toArrow().to_batches():
        held[row.column(0).to_numpy()] = row.column(1).to_numpy()
    return held


def _packed(source: DataFrame, width: int, bitmap, singles: np.ndarray) -> DataFrame:
    """(doc, start, n, digest, bucket, sent, packed): the super-k-mers whose minimisers recur.

    ``packed`` is null, and ``sent`` false, for strings that the same run has already sent for
    a smaller document.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in batches:
            doc = batch.column(0).to_numpy(zero_copy_only=False)
            for texts in runs(batch.column(1)):
                w = _Windows(texts, width)
                slot = w.minimiser & np.uint64((1 << BITS) - 1)
                word = bits[(slot >> np.uint64(6)).astype(np.int64)]
                open_ = (word >> (slot & np.uint64(63)).astype(np.int64) & 1).astype(bool)
                if not open_.any():
                    continue
                key = w.minimiser.view(np.int64)
                alone = np.isin(key, singles)
                change = np.ones(len(key), dtype=bool)
                change[1:] = (key[1:] != key[:-1]) | (w.text[1:] != w.text[:-1])
                change |= alone
                begin = np.flatnonzero(change)
                count = np.diff(np.append(begin, len(key)))
                keep = open_[begin]
                begin, count = begin[keep], count[keep]
                bucket = np.where(alone[begin], w.hash.view(np.int64)[begin], key[begin])
                first = w.first[begin]
                flat, at = _joined(texts.data, w.spans, first, count + width - 1)
                raw, edges = flat.tobytes(), at.tolist()
                strings = [raw[a : b - 1] for a, b in zip(edges, edges[1:])]
                digest = [xxhash.xxh3_128_digest(s) for s in strings]
                own = doc[texts.first + w.text[begin]]
                least: dict[bytes, int] = {}
                sent = np.ones(len(strings), dtype=bool)
                for i in np.argsort(own, kind="stable").tolist():
                    if least.setdefault(digest[i], i) != i and own[least[digest[i]]] != own[i]:
                        strings[i], sent[i] = None, False
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own), pa.array(first - w.spans.at[w.text[begin]]), pa.array(count),
                        pa.array(digest, pa.binary()), pa.array(bucket), pa.array(sent), pa.array(strings, pa.binary()),
                    ],
                    ["doc", "start", "n", "digest", "bucket", "sent", "packed"],
                )

    return source.select("_doc", "_text").mapInArrow(
        task, "doc long, start long, n long, digest binary, bucket long, sent boolean, packed binary"
    )


def _joined(data: np.ndarray, spans: Words, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, where each begins) of n words from the first on, each word with one space after it."""
    index = ragged(first, n)
    length = spans.end[index] - spans.start[index] + 1
    flat = np.append(data, np.uint8(32))[ragged(spans.start[index], length)]
    after = np.cumsum(length)
    flat[after - 1] = 32
    return flat, np.concatenate([[0], after])[np.concatenate([[0], np.cumsum(n)])]


def _same(data: np.ndarray, begin: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the windows a have the same bytes as the windows b, one by one."""
    length = end[a] - begin[a]
    if not np.array_equal(length, end[b] - begin[b]):
        return False
    return np.array_equal(data[ragged(begin[a], length)], data[ragged(begin[b], length)])


def _sorted_windows(doc: np.ndarray, start: np.ndarray, packed: pa.Array, width: int):
    """(doc, start) of the windows that occur in a smaller document too.

    Windows are sorted by the hash of their words, then by document; equal hashes are
    compared word by word, so the result is exact.
    """
    for texts in runs(packed, 1 << 40):
        spans = words(texts)
        n = np.diff(spans.at) - width + 1
        first = ragged(spans.at[:-1], n)
        owner = np.repeat(np.arange(len(n)), n)
        begin, end = spans.start[first], spans.end[first + width - 1]
        h = hashes(texts.data, begin, end)
        d = doc[owner]
        order = np.lexsort((d, h))
        h, d, begin, end = h[order], d[order], begin[order], end[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        group = np.cumsum(np.concatenate([[True], h[1:] != h[:-1]])) - 1
        head = at[group]
        again = np.flatnonzero(d > d[head])
        exact = all(
            _same(texts.data, begin, end, again[k : k + COMPARED], head[again[k : k + COMPARED]])
            for k in range(0, len(again), COMPARED)
        )
        if exact:
            lost = order[again]
        else:  # two window texts share a hash: group by the texts themselves
            raw = texts.data.tobytes()
            least: dict[bytes, int] = {}
            keys = [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]
            for key, x in zip(keys, d.tolist()):
                least[key] = min(least.get(key, x), x)
            lost = order[[i for i, (key, x) in enumerate(zip(keys, d.tolist())) if x > least[key]]]
        place = start[owner[lost]] + (first - spans.at[:-1][owner])[lost]
        yield d[np.argsort(order)][lost], place


def _buckets(packed: DataFrame, strings: DataFrame, width: int) -> DataFrame:
    """(doc, start, n): stretches of windows that occur in a smaller document of their bucket.

    A string's later documents have lost all its windows already, and its first document
    stands for them in the bucket, so they may stay away. Those of the strings in
    ``strings`` that make up more than their share of all that is sent do; fewer than
    ``SETTLED`` strings can, so they may be broadcast.
    """

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        doc, start = rows["doc"].to_numpy(), rows["start"].to_numpy()
        strings = rows.combine_chunks()["packed"].chunk(0).cast(pa.large_binary())
        for d, s in _sorted_windows(doc, start, strings, width):
            order = np.lexsort((s, d))
            d, s = d[order], s[order]
            if not len(d):
                continue
            new = np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] > s[:-1] + 1)])
            begin = np.flatnonzero(new)
            end = np.append(begin[1:], len(d)) - 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(d[begin]), pa.array(s[begin]), pa.array(s[end] - s[begin] + 1)], ["doc", "start", "n"]
            )

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size < SORT_BYTES:
                continue
            rows = pa.Table.from_batches(held)
            bucket = rows["bucket"].to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on in the next batch
            if cut:
                yield from settle(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
                size = sum(b.nbytes for b in held)
        if size:
            yield from settle(pa.Table.from_batches(held))

    total = packed.filter("sent").count()
    frequent = strings.filter(F.col("_sent") * F.lit(SETTLED) > F.lit(total)).select("digest", "first")
    sent = packed.filter("sent").select("bucket", "doc", "start", "digest", "packed")
    if frequent.limit(1).count():
        sent = sent.join(F.broadcast(frequent), "digest", "left").filter("first is null or doc = first")
    sent = sent.select("bucket", "doc", "start", "packed")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(task, "doc long, start long, n long")


def _keys(rows: DataFrame, column: str) -> DataFrame:
    """The distinct 64-bit keys of a column, written, as ``with_members`` takes them."""
    return durable_table(rows.select(F.xxhash64(column).alias("_key")).distinct())


def repeated_windows(source: DataFrame, width: int) -> DataFrame:
    """(doc, start, n): n windows from word ``start`` on that also start in a smaller document.

    ``source`` has the columns ``_doc`` (long, no nulls) and ``_text`` (binary, no nulls).
    """
    spark = source.sparkSession
    counted = durable_table(_minimisers(source, width).filter("low < high"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    # Fewer minimisers than four per shuffle partition can have so large a share.
    heavy = counted.filter(F.col("n") * F.lit(slots(spark)) > F.lit(total)).select("key")
    singles = np.sort(np.array([r.key for r in heavy.collect()], dtype=np.int64))
    bitmap = spark.sparkContext.broadcast(_bitmap(spark, counted))

    packed = durable_table(_packed(source, width, bitmap, singles))
    strings = durable_table(
        packed.groupBy("digest")
        .agg(
            F.min("doc").alias("first"), F.max("doc").alias("last"),
            F.count(F.lit(1)).alias("_n"), F.count_if("sent").alias("_sent"),
        )
        .filter("first < last")
    )
    # Strings that occur once are left out before anything is shuffled; the join is exact.
    near = packed.select("digest", "doc", "start", "n")
    met = with_members(near, F.xxhash64("digest"), _keys(strings, "digest"), "_met")
    near = near if met is None else met.filter("_met").drop("_met")
    copies = (
        spread_join(near, strings, "digest", "_n")
        .filter("doc > first")
        .select("doc", "start", "n")
    )
    return copies.unionByName(_buckets(packed, strings, width))


def drop_repeated_windows(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 13
) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_removed, kept_text (kept words, one space between).

    A window is ``width`` consecutive words of one document, at least five. Every word is
    removed that lies in a window whose words also start in a document with a smaller id;
    windows are judged on the input. A null or blank text has no words. Rows that share an
    id are one document: copies within it are kept. A null id counts as smaller than all
    others. Ids are whole numbers, or strings of them. Other columns are not read; an empty
    table gives no rows.
    """
    if width < GRAM:
        raise ValueError(f"windows have {GRAM} words or more")
    bounded_batches(docs)
    least = F.lit(-(1 << 63)).cast("long")
    source = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.col(id_col).cast("long"), least).alias("_doc"),
        text_of(text_col).cast("binary").alias("_text"),
    )
    found = repeated_windows(source, width)
    lost = durable_table(
        found.groupBy(F.col("doc").alias("_doc")).agg(F.collect_list(F.struct("start", "n")).alias("_lost"))
    )
    kind = source.schema["_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            starts, counts = lists.values.field(0).to_numpy(), lists.values.field(1).to_numpy()
            edges = lists.offsets.to_numpy()
            for texts in runs(batch.column(1)):
                spans = words(texts)
                n = np.diff(spans.at)
                change = np.zeros(len(spans.start) + 1, dtype=np.int64)
                rows = np.arange(texts.first, texts.first + len(texts))
                per = np.diff(edges)[rows]
                which = ragged(edges[rows], per)
                base = np.repeat(spans.at[:-1], per)
                # A row may be shorter than another row of its document.
                top = np.repeat(spans.at[1:], per)
                begin = np.minimum(base + starts[which], top)
                end = np.minimum(base + starts[which] + counts[which] + width - 1, top)
                np.add.at(change, begin, 1)
                np.add.at(change, end, -1)
                kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                n_kept = np.diff(np.searchsorted(kept, spans.at))
                length = spans.end[kept] - spans.start[kept] + 1
                flat = np.append(texts.data, np.uint8(32))[ragged(spans.start[kept], length)]
                after = np.cumsum(length)
                flat[after - 1] = 32
                at = np.concatenate([[0], after])[np.concatenate([[0], np.cumsum(n_kept)])].tolist()
                raw = flat.tobytes()
                strings = [raw[a : max(a, b - 1)] for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(texts.first, len(texts)), pa.array(n), pa.array(n - n_kept),
                        pa.array(strings, pa.binary()).cast(pa.string()),
                    ],
                    ["_id", "n_words", "n_removed", "kept_text"],
                )

    none = F.array().cast("array<struct<start:bigint,n:bigint>>")
    schema = f"_id {kind}, n_words long, n_removed long, kept_text string"

    # Only documents that may lose words are shuffled; the rest are read where they are.
    marked = with_members(source, F.xxhash64("_doc"), _keys(lost, "_doc"), "_some")
    if marked is None:
        marked = source.withColumn("_some", F.lit(True))
    near = marked.filter("_some").join(lost, "_doc", "left").select("_id", "_text", F.coalesce("_lost", none).alias("_lost"))
    far = marked.filter("not _some").select("_id", "_text", none.alias("_lost"))
    parts = near.mapInArrow(cut, schema).unionByName(far.mapInArrow(cut, schema))
    return parts.withColumnRenamed("_id", id_col)
