"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words: masked-out positions are ignored, and the
masks are such that a test passage with as many words exchanged as the rule allows shares
a seed with a copy of it, wherever they stand. The test
side is hashed in blocks of bounded size that are sent to every task; the training side
is hashed while it is scanned, and never shuffled. Around a shared seed the two word
sequences are laid side by side and the stretch with most words alike, among those that
agree in the least share, is measured.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbundle.llm.common import bounded_batches, durable_table, text_of
from corpusbundle.llm.spans import Texts, Words, _spans, filled, hashes, lowered, mixed, ragged, runs

#: A stretch must agree in this share of its words, and in so many words (all, for shorter items).
SHARE, LEAST_WORDS = (4, 5), 13

#: Test items of fewer words cannot be told from chance inside a text; they match texts of just their words.
SHORTEST = 5

#: From so many words on an item has the far mask, for five alike at both ends of twenty and short runs between.
_FAR_WORDS, _FAR = 20, "111" + "0" * 12 + "111"

#: Test items are taken in blocks of about so many bytes of text.
BLOCK_BYTES = 4 << 20

_FILTER_BITS = 22
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


def plain_words(texts: Texts) -> tuple[np.ndarray, Words]:
    """Hashes of lower-cased words; a word is a run of ASCII letters, digits and other scripts."""
    low = lowered(texts)
    spans = _spans(_LETTER[low.data], low.offsets)
    return hashes(low.data, spans.start, spans.end), spans


def _kept(width: int, blocks: int, keep: int) -> set[str]:
    """The masks that keep so many of a row of blocks, wherever they begin."""
    rows = combinations(range(blocks), keep)
    return {"".join("01"[k in kept] * width for k in range(blocks)).strip("0") for kept in rows}


def masks_of(n: int) -> set[str]:
    """Masks for an item of n words: 1 counts, 0 is ignored.

    A passage that agrees with the item as the rule asks has one of them whole. Up to 16
    words the words not alike spoil one block each, and the other blocks are kept. Longer
    items need 13 words alike in some stretch; that the masks for 15 words and the far one
    meet every such stretch is shown by enumeration in the tests.
    """
    if n < SHORTEST:
        return {"1" * n} - {""}
    if n < 6:
        return _kept(1, 5, 4)
    if n < 10:
        return _kept(n // 3, 3, 2)
    if n < 12:
        return _kept(2, 5, 3)
    return _kept(3, 4 if n < 15 else 5, 2) | ({_FAR} if n >= _FAR_WORDS else set())


def _seed_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """The seed hash at each position where the whole mask fits."""
    n = len(words) - len(mask) + 1
    total = np.zeros(max(n, 0), dtype=np.uint64)
    if n > 0:
        for at, on in enumerate(mask):
            if on == "1":
                total = total * _STEP + words[at : at + n]
    return mixed(total)


@dataclass
class ItemBlock:
    """A block of test items with their seeds in hash order, and a bitmap of those hashes."""

    ids: list
    words: np.ndarray
    at: np.ndarray
    masks: list[str]
    seed: list[np.ndarray]
    place: list[np.ndarray]
    filter: list[np.ndarray]

    @classmethod
    def of(cls, ids: list, texts: list[str | None]) -> ItemBlock:
        column = pa.array([(t or "").encode() for t in texts], pa.binary())
        hashed, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for run in runs(column):
            h, spans = plain_words(run)
            hashed.append(h)
            counts.append(np.diff(spans.at))
        words, n = np.concatenate(hashed), np.concatenate(counts)
        at = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
        item_of = np.repeat(np.arange(len(n)), n)
        lengths = {int(x) for x in np.unique(np.minimum(n, _FAR_WORDS))}
        masks = sorted(set().union(*map(masks_of, lengths)))
        block = cls(ids, words, at, masks, [], [], [])
        for mask in masks:
            h = _seed_hashes(words, mask)
            has = np.array([mask in masks_of(x) for x in range(_FAR_WORDS + 1)])
            place = np.arange(len(h))
            inside = item_of[place] == item_of[place + len(mask) - 1] if len(h) else np.zeros(0, bool)
            size = n[item_of[place]] if len(h) else np.zeros(0, np.int64)
            fits = inside & has[np.minimum(size, _FAR_WORDS)]
            h, place = h[fits], place[fits]
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << _FILTER_BITS, dtype=bool)
            bits[h & np.uint64((1 << _FILTER_BITS) - 1)] = True
            block.seed.append(h[order])
            block.place.append(place[order])
            block.filter.append(bits)
        return block

    def overlaps(self, words: np.ndarray, at: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, words alike, words of the stretch, start in the text, start in the item).

        One entry per text and item that overlap: the stretch with the most words alike.
        """
        found: list[np.ndarray] = []
        text_of = np.repeat(np.arange(len(at) - 1), np.diff(at))
        item_of = np.repeat(np.arange(len(self.at) - 1), np.diff(self.at))
        for number, mask in enumerate(self.masks):
            if not len(self.seed[number]):
                continue
            h = _seed_hashes(words, mask)
            maybe = np.flatnonzero(self.filter[number][h & np.uint64((1 << _FILTER_BITS) - 1)])
            maybe = maybe[text_of[maybe] == text_of[maybe + len(mask) - 1]]
            low = np.searchsorted(self.seed[number], h[maybe], side="left")
            n = np.searchsorted(self.seed[number], h[maybe], side="right") - low
            place, spot = self.place[number][ragged(low, n)], np.repeat(maybe, n)
            text, item = text_of[spot], item_of[place]
            own, whole = np.diff(at)[text], np.diff(self.at)[item]
            fits = (whole >= SHORTEST) | (whole == own)
            found.append(np.stack([spot - place, text, item])[:, fits])
        if not found:
            return []
        # Seeds on one diagonal of a text and an item are one overlap to measure.
        diagonals = np.unique(np.concatenate(found, axis=1), axis=1).T
        best: dict[tuple[int, int], tuple] = {}
        for shift, text, item in diagonals.tolist():
            a, b = self.at[item], self.at[item + 1]
            first, last = max(a, at[text] - shift), min(b, at[text + 1] - shift)
            same = words[first + shift : last + shift] == self.words[first:last]
            alike, begin, end = _best_stretch(same)
            if alike >= min(LEAST_WORDS, -(-(b - a) * SHARE[0] // SHARE[1])):
                row = (alike, end - begin, int(first + shift - at[text]) + begin, int(first - a) + begin)
                best[text, item] = max(best.get((text, item), row), row)
        return [(*key, *row) for key, row in sorted(best.items())]


def _best_stretch(same: np.ndarray) -> tuple[int, int, int]:
    """(words alike, begin, end) of the stretch with most words alike, of those with the least share.

    A word alike scores 1; one that differs costs so much that a stretch of the least
    allowed share scores nothing. For each end, the first begin from which the score is not
    negative gives most words; it is found among the minima of the scores so far.
    """
    total = np.concatenate([[0], np.cumsum(np.where(same, SHARE[1] - SHARE[0], -SHARE[0]))])
    count = np.concatenate([[0], np.cumsum(same)])
    begin = np.searchsorted(-np.minimum.accumulate(total), -total, side="left")
    alike = count - count[begin]
    end = int(np.argmax(alike))
    begin = int(begin[end])
    if end > begin:
        begin += int(np.argmax(same[begin:end]))  # without differing words in front
    return int(alike[end]), begin, end


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_item, _key, _text): the test items, with a digest of their text."""
    text = text_of(text_col)
    return durable_table(benchmark.select(F.col(id_col).alias("_item"), F.sha2(text, 256).alias("_key"), text.alias("_text")))


def _blocks(items: DataFrame) -> Iterator[ItemBlock]:
    """The distinct texts of the test items, by digest, in blocks that a task can hold; one block unless they are many."""
    texts = durable_table(items.groupBy("_key").agg(F.first("_text").alias("_text")))
    size = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    n = int(size // BLOCK_BYTES) + 1
    place = F.pmod(F.xxhash64("_key"), F.lit(n))
    for k in range(n):
        rows = texts.filter(place == k).sort("_key").collect()
        if rows:
            yield ItemBlock.of([r._key for r in rows], [r._text for r in rows])


def _measure(block: ItemBlock, column: pa.Array) -> Iterator[tuple[int, list]]:
    for run in runs(column):
        words, spans = plain_words(run)
        yield run.first, block.overlaps(words, spans.at)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """One row per document and test item that overlap: doc_id, item_id, n_alike, n_words, doc_start, item_start.

    The stretch is given in words, with how many are alike. A document overlaps an item if
    some stretch of both has at least 80 % of its words alike and 13 words alike, or 80 %
    of the item's words where it is shorter; an item of fewer than five words, a document of
    just the same words. Items without words match nothing.
    Null texts are empty and match nothing; a null id stays null. Repeated documents have
    their rows each, and so have repeated items, which are looked for once. Ids may be of
    any type. Other columns are not read; an empty table
    on either side gives no rows.
    """
    bounded_batches(docs)
    source = docs.select(F.col(id_col).alias("_id"), text_of(text_col).cast("binary").alias("_text"))
    items = _items(benchmark, item_col, item_text_col)
    names = ["n_alike", "n_words", "doc_start", "item_start"]
    kind = source.schema["_id"].dataType.simpleString()
    schema = f"_id {kind}, _key string, " + ", ".join(f"{n} long" for n in names)

    def task(block: ItemBlock):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(first + t, i, *m) for first, found in _measure(block, batch.column(1)) for t, i, *m in found]
                picked = [list(c) for c in zip(*rows)] or [[]] * 6
                numbers = [pa.array(c, pa.int64()) for c in picked[2:]]
                ids = batch.column(0).take(pa.array(picked[0], pa.int64()))
                if not rows:
                    continue
                keys = pa.array([block.ids[i] for i in picked[1]], pa.string())
                yield pa.RecordBatch.from_arrays([ids, keys, *numbers], ["_id", "_key", *names])

        return run

    result = None
    for block in _blocks(items):
        part = source.mapInArrow(task(block), schema)
        result = part if result is None else result.unionByName(part)
    if result is None:
        result = docs.sparkSession.createDataFrame([], schema)
    found = result.join(items.select("_item", "_key"), "_key")
    return found.select(F.col("_id").alias(id_col), F.col("_item").alias(item_col), *names)


def drop_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` that overlap no test item, with their columns; see ``contaminated``."""
    bounded_batches(docs)
    kept, at = docs, docs.columns.index(text_col)

    def task(block: ItemBlock):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, dtype=bool)
                for first, found in _measure(block, filled(batch.column(at))):
                    clean[[first + t for t, *_ in found]] = False
                yield batch.filter(pa.array(clean))

        return run

    for block in _blocks(_items(benchmark, item_col, item_text_col)):
        kept = kept.mapInArrow(task(block), kept.schema)
    return kept
