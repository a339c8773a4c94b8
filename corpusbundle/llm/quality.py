"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams of words, of word shapes and of whether a word repeats
the one before it. Each is scaled by the log ratio of its smoothed frequency in the two
classes; a linear hinge-loss model over the scaled indicators is fitted by dual coordinate
descent. Features are hashed, so the model has one size at every input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusbundle.llm.common import bounded_batches, durable_table, text_of
from corpusbundle.llm.spans import Texts, Words, _spans, filled, hashes, lowered, mixed, ragged, runs, words

#: Hashed features: 2**BITS.
BITS = 18

#: The model is fitted on at most so many labelled documents, those with the smallest hashes.
SAMPLE = 8_000

#: Of these, every fifth is left out of the fit and gives the scale of the score.
CALIBRATION = 5

_LETTER = np.zeros(256, dtype=bool)
_LETTER[48:58] = _LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = ord("0"), ord("A"), ord("a"), ord("a")


def _shapes(texts: Texts, spans: Words) -> np.ndarray:
    """Hash of each word's shape: its character classes with repetitions written once."""
    kind = _SHAPE[texts.data]
    first = np.ones(len(kind), dtype=bool)
    first[1:] = kind[1:] != kind[:-1]
    first[spans.start] = True
    place = np.concatenate([[0], np.cumsum(first)])
    squeezed = kind[first]
    start, end = place[spans.start], place[spans.end]
    # A word's last class may be followed by the same class of the space after it, never inside it.
    return hashes(squeezed, start, np.maximum(end, start + 1))


def _grams(h: np.ndarray, at: np.ndarray, width: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the n-grams of one width."""
    n = np.maximum(np.diff(at) - width + 1, 0)
    place = ragged(at[:-1], n)
    total = np.full(len(place), kind, dtype=np.uint64)
    for k in range(width):
        total = mixed(total * np.uint64(3) + h[place + k])
    return total, np.repeat(np.arange(len(n)), n)


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(features, where each text's begin): the distinct hashed n-grams of each text."""
    spans = words(texts)
    shape = _shapes(texts, spans)
    low = lowered(texts)
    letters = _spans(_LETTER[low.data], low.offsets)
    word = hashes(low.data, letters.start, letters.end)
    again = np.zeros(len(word), dtype=np.uint64)
    again[1:] = word[1:] == word[:-1]
    parts = [
        _grams(again, letters.at, 4, 6),
        _grams(word, letters.at, 1, 1),
        _grams(word, letters.at, 2, 2),
        _grams(shape, spans.at, 1, 3),
        _grams(shape, spans.at, 2, 4),
        _grams(shape, spans.at, 3, 5),
    ]
    slot = np.concatenate([h & np.uint64((1 << BITS) - 1) for h, _ in parts]).astype(np.int64)
    owner = np.concatenate([t for _, t in parts])
    both = np.unique(owner << BITS | slot)
    return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(len(texts) + 1))


@dataclass
class Model:
    """Weight of each feature, bias, and the slope and offset from margin to score."""

    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, column: pa.Array) -> np.ndarray:
        found = [np.zeros(0)]
        for texts in runs(column):
            slot, at = features(texts)
            total = np.concatenate([[0.0], np.cumsum(self.weight[slot], dtype=np.float64)])
            margin = _scaled(total[at[1:]] - total[at[:-1]], np.diff(at)) + self.bias
            found.append(1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -30, 30))))
        return np.concatenate(found)


def _scaled(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Margins of unit-length rows of indicators, so that long texts do not outweigh short ones."""
    return sums / np.sqrt(np.maximum(n, 1))


def _descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, rounds: int):
    """Dual coordinate descent for the L1-loss support vector machine; the bias is a last feature."""
    w, bias = np.zeros(1 << BITS), 0.0
    alpha = np.zeros(len(rows))
    norm = np.array([v @ v + 1.0 for v in values])
    order = np.arange(len(rows))
    rng = np.random.default_rng(0)
    for _ in range(rounds):
        rng.shuffle(order)
        moved = 0.0
        for i in order:
            gradient = y[i] * (w[rows[i]] @ values[i] + bias) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[rows[i]] += step * values[i]
                bias += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def _logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, by Newton steps."""
    good, bad = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        gradient = x.T @ (p - target) + 1e-3 * b
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        b = b - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0, cost: float = 1.0, rounds: int = 20) -> Model:
    """The model of labelled rows of features. Without rows of both classes the score is constant."""
    y = np.where(labels > 0, 1, -1)
    if len(rows) == 0 or (y > 0).all() or (y < 0).all():
        share = 0.5 if len(rows) == 0 else (np.sum(y > 0) + 1) / (len(y) + 2)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    held = np.arange(len(rows)) % CALIBRATION == 0
    if len(set(y[~held])) < 2 or len(set(y[held])) < 2:
        held = np.zeros(len(rows), dtype=bool)
    use = np.flatnonzero(~held)

    def frequency(of: int) -> np.ndarray:
        own = [rows[i] for i in use if y[i] == of]
        counts = np.bincount(np.concatenate(own), minlength=1 << BITS) if own else np.zeros(1 << BITS)
        return (counts + smoothing) / (len(own) + 2 * smoothing)

    ratio = np.log(frequency(1) / frequency(-1))
    values = [(ratio[rows[i]] / np.sqrt(max(len(rows[i]), 1))).astype(np.float32) for i in use]
    # Both classes weigh the same in sum.
    share = np.array([np.mean(y[use] == v) for v in y[use]])
    w, bias = _descend([rows[i] for i in use], values, y[use], cost * 0.5 / share, rounds)
    weight = w * ratio
    margin = np.array([_scaled(weight[r].sum(), np.array(len(r))) for r in rows]) + bias
    fold = held if held.any() else ~held
    slope, offset = _logistic(margin[fold], y[fold])
    return Model(weight.astype(np.float32), bias, slope, offset)


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = SAMPLE,
) -> Model:
    """Fit on at most ``sample`` labelled documents.

    Rows with a null id or label are not labelled. An id labelled more than once has the
    larger label; a document that occurs more than once counts once, and if its texts differ,
    the one whose list of features comes first counts.
    """
    bounded_batches(docs)
    chosen = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(label_col).cast("int").alias("_y"))
        .withColumn("_order", F.xxhash64("_id"))
        .orderBy("_order", "_id")
        .limit(sample)
    )
    chosen = durable_table(chosen)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [features(texts) for texts in runs(batch.column(2))]
            lists = [slot[a:b] for slot, at in parts for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lists, pa.list_(pa.int32()))], ["_order", "_y", "_slots"]
            )

    # At most ``sample`` narrow rows, so they may be broadcast.
    found = docs.select(F.col(id_col).alias("_id"), text_of(text_col).cast("binary").alias("_text"))
    labelled = found.join(F.broadcast(chosen), "_id").select("_order", "_y", "_text")
    rows = labelled.mapInArrow(extract, "_order long, _y int, _slots array<int>")
    one = rows.groupBy("_order").agg(F.max("_y").alias("_y"), F.min("_slots").alias("_slots"))
    got = one.toArrow().sort_by("_order")
    slots = [np.asarray(s.values) for s in got["_slots"]]
    return fit(slots, got["_y"].to_numpy())


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1; empty and null texts have that of no features.

    A column that already has the score's name is replaced.
    """
    bounded_batches(docs)
    docs = docs.drop(name)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array(model.scores(filled(batch.column(at))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*batch.schema.names, name])

    at = docs.columns.index(text_col)
    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text has the remainder ``fold``; a null id counts as empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds == fold
