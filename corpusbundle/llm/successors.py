"""What follows a word: counted pairs of neighbouring tokens, and how far to trust them.

A token is drawn from what followed the token before it, else from the words by their
counts, else it is spelled. Each choice is a binary decision whose probability is mixed
in the logistic domain from hashed contexts, with weights chosen by a gate and refined by
what was met in each cell. Pair counts are a table that grows with the corpus: tasks
count what they read, sorted runs of 64-bit keys meet by hash, and no key is hot, since a
task hands on each pair once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbundle.llm.common import durable_table, spread_join
from corpusbundle.llm.spans import Texts, Words, hashes, mixed, runs

#: Occurrences from which a pair is evidence.
LEAST = 4

#: Pairs a task holds before it hands them on, keys of one row, and occurrences a block of pairs is made for.
HELD = 1 << 22
ROW = 1 << 10
BLOCK = 1 << 21

#: Gate: logarithm of the context's count. Cells of a gate: share of the context's tokens that are in pairs.
GATES, CELLS = 40, 41

#: A cell's own record weighs as much as the mixed prediction from so many tokens on.
TRUST = 50.0

_BATCH = ["block", "keys", "counts"]


def token_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """32-bit hashes of byte spans, as 64-bit numbers."""
    return hashes(data, start, end) >> np.uint64(32)


#: The empty token, which ends a text and stands before the next one.
END = int(token_hashes(np.zeros(1, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64))[0])


def neighbours(texts: Texts, spans: Words) -> tuple[np.ndarray, np.ndarray]:
    """(key of each token with the one before, where each text's tokens begin); the last token of a text is its end."""
    after = np.insert(token_hashes(texts.data, spans.start, spans.end), spans.at[1:], END)
    before = np.empty_like(after)
    before[:1] = END
    before[1:] = after[:-1]
    return before << np.uint64(32) | after, spans.at + np.arange(len(spans.at))


def _packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Steps between sorted keys, and counts, byte plane by byte plane: high bytes are mostly zero."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return steps.T.tobytes(), counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps = np.frombuffer(keys, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel()
    return np.cumsum(steps, dtype=np.uint64), np.frombuffer(counts, np.uint8).reshape(4, -1).T.copy().view("<u4").ravel()


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[order].astype(np.int64), first)


def _dealt(held: list[np.ndarray], blocks: int) -> Iterator[pa.RecordBatch]:
    keys, counts = np.unique(np.concatenate(held), return_counts=True)
    block = (mixed(keys) >> np.uint64(20)).astype(np.int64) % blocks
    order = np.argsort(block, kind="stable")
    keys, counts, block = keys[order], counts[order], block[order]
    edges = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
    rows = [(a, min(a + ROW, z)) for s, z in zip(edges, edges[1:]) for a in range(s, z, ROW)]
    packed = [_packed(keys[a:z], counts[a:z]) for a, z in rows]
    columns = [[int(block[a]) for a, _ in rows], [k for k, _ in packed], [c for _, c in packed]]
    types = [pa.int64(), pa.binary(), pa.binary()]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], _BATCH)


def pair_counts(texts: DataFrame, tokens_of, n: int) -> DataFrame:
    """(key, spread, c) of all neighbouring tokens met LEAST times or more in ``_text``, as a written table.

    ``spread`` is the key with its bits mixed, for filters.
    ``tokens_of`` gives the lower-cased texts and word spans of a run, ``n`` is the number
    of tokens: blocks of pairs are made so that each fits a task at any ``n``.
    """
    blocks = max(1, -(-n // BLOCK))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for run in runs(batch.column(0)):
                keys, _ = neighbours(*tokens_of(run))
                held.append(keys)
                size += len(keys)
                if size > HELD:
                    yield from _dealt(held, blocks)
                    held, size = [], 0
        if held:
            yield from _dealt(held, blocks)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            keys, counts = _summed(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
            kept = counts >= LEAST
            keys = keys[kept]
            columns = [keys.view(np.int64), mixed(keys).view(np.int64), counts[kept]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "spread", "c"])

        block, held = None, []
        for batch in batches:
            for b, keys, counts in zip(*(x.to_pylist() for x in batch.columns)):
                if b != block and held:
                    yield out()
                    held = []
                block = b
                held.append(_unpacked(keys, counts))
        if held:
            yield out()

    rows = texts.select("_text").mapInArrow(count, "block long, keys binary, counts binary")
    sorted_rows = rows.repartition("block").sortWithinPartitions("block")
    return durable_table(sorted_rows.mapInArrow(add, "key long, spread long, c long"))


@dataclass
class Shares:
    """How likely a token is taken from the counts, by gate and cell; and what cells hold."""

    share: np.ndarray

    def column(self, gate, cell):
        """The share as a column; there are at most GATES x CELLS values."""
        table = F.lit(self.share.ravel())
        return F.element_at(table, (gate * CELLS + cell + 1).cast("int"))


def fit_shares(gate: np.ndarray, cell: np.ndarray, gain: np.ndarray, weight: np.ndarray, passes: int = 60) -> Shares:
    """Learn the decision from a table of cases.

    ``gain`` is the natural logarithm of how much likelier a token is by the counts than
    without them (-inf if the counts, without the token itself, do not hold it). Online
    passes move the gate's weights towards what the cases say; the record of each cell
    then refines what was mixed. The order of the cases does not matter but for rounding.
    """
    grid = (np.arange(CELLS) - CELLS // 2) / 2.0
    inputs = np.stack([grid, np.ones(CELLS)], axis=1)
    weights = np.tile([0.3, 0.0], (GATES, 1))
    flat = gate * CELLS + cell
    lift = np.exp(np.minimum(gain, 30.0))
    total = np.bincount(flat, weight, GATES * CELLS).reshape(GATES, CELLS)
    scale = np.einsum("gc,ci,cj->gij", total, inputs, inputs) / 4 + np.eye(2)

    def expected(share: np.ndarray) -> np.ndarray:
        own = share.ravel()[flat]
        taken = own * lift / (own * lift + 1 - own)
        return np.bincount(flat, weight * taken, GATES * CELLS).reshape(GATES, CELLS)

    def share() -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(weights @ inputs.T, -12, 12)))

    for _ in range(passes):
        now = share()
        moved = (expected(now) - total * now) @ inputs
        weights = weights + np.linalg.solve(scale, moved[:, :, None])[:, :, 0]
    now = share()
    for _ in range(passes // 6):
        now = (expected(now) + TRUST * share()) / (total + TRUST)
    return Shares(np.clip(now, 1e-6, 1 - 1e-6))


def _fitted(cases: DataFrame) -> Shares:
    """Fit on (gate, cell, gain, n), summed to a bounded number of cases; gain is null where counts do not help."""
    step = F.floor(F.least(F.greatest("gain", F.lit(-12.0)), F.lit(20.0)) * 4)
    summed = cases.groupBy("gate", "cell", step.alias("step")).agg(F.sum("n").alias("n"))
    got = summed.orderBy("gate", "cell", "step").toArrow()
    step = got["step"].to_pandas().to_numpy(np.float64, na_value=-np.inf)
    columns = (got[x].to_numpy().astype(np.int64) for x in ("gate", "cell"))
    return fit_shares(*columns, (step + 0.5) / 4, got["n"].to_numpy().astype(np.float64))


def by_counts(scored: DataFrame, n: int) -> tuple[DataFrame, float]:
    """Rows (word, c, p) whose p also draws on the word's count; and log10 of what is left for spelling.

    Of no tokens (``n`` is 0) nothing is drawn.
    """
    if n == 0:
        return scored, 0.0
    own = F.when(F.col("c") > 1, F.log((F.col("c") - 1) / F.lit(float(max(n - 1, 1)))) - F.col("p") * F.lit(np.log(10)))
    case = scored.select(F.lit(0).alias("gate"), F.lit(0).alias("cell"), own.alias("gain"), F.col("c").alias("n"))
    share = float(_fitted(case).share[0, 0])
    p = F.log10(F.lit(share) * F.col("c") / F.lit(float(max(n, 1))) + F.lit(1 - share) * F.pow(F.lit(10.0), "p"))
    return scored.withColumn("p", p), float(np.log10(1 - share))


def pair_gains(scored: DataFrame, counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hash, left) and (key, spread, c, gain) for scored words (word, c, p, hash) and counted pairs.

    ``left`` is log10 of the share that a context leaves to tokens outside its pairs; in a
    text each token is the context of one other, so it can be summed by token (see
    ``as_contexts``). ``gain`` is log10 of how much likelier the second token of a pair is
    for the pair's sake. Words of one hash are one context. Both are written tables.
    """
    counts = counts.select(
        "key", "spread", F.col("c").alias("pair_c"),
        F.shiftrightunsigned("key", 32).alias("before"), F.col("key").bitwiseAND(F.lit(0xFFFFFFFF)).alias("after"),
    )
    # A pair met LEAST times has words met as often.
    often = scored.filter(F.col("c") >= LEAST).groupBy("hash").agg(F.sum("c").alias("c"), F.max("p").alias("p"))
    within = counts.groupBy("before").agg(F.sum("pair_c").alias("within"))
    gate = F.least(F.floor(F.log2("c")), F.lit(GATES - 1))
    odds = F.log((F.col("within") + 0.5) / (F.greatest(F.col("c") - F.col("within"), F.lit(0)) + 0.5))
    cell = F.least(F.greatest(F.round(odds * 2) + CELLS // 2, F.lit(0)), F.lit(CELLS - 1))
    contexts = durable_table(
        within.join(often.withColumnRenamed("hash", "before"), "before")
        .select("before", "c", "within", gate.cast("int").alias("gate"), cell.cast("int").alias("cell"))
    )
    after = durable_table(often.select(F.col("hash").alias("after"), "c", "p"))
    pairs = spread_join(counts, contexts, "before", "c").select(
        "key", "spread", "after", "pair_c", F.col("c").alias("before_c"), "gate", "cell"
    )
    pairs = durable_table(spread_join(durable_table(pairs), after, "after", "c").drop("c"))

    without = F.log((F.col("pair_c") - 1) / (F.col("before_c") - 1)) - F.col("p") * F.lit(np.log(10))
    cases = pairs.select("gate", "cell", F.when(F.col("pair_c") > LEAST, without).alias("gain"), F.col("pair_c").alias("n"))
    others = contexts.select(
        "gate", "cell", F.lit(None).cast("double").alias("gain"), F.greatest(F.col("c") - F.col("within"), F.lit(0)).alias("n")
    )
    shares = _fitted(cases.unionByName(others))

    share = shares.column(F.col("gate"), F.col("cell"))
    lift = share / (1 - share) * (F.col("pair_c") / F.col("before_c")) / F.pow(F.lit(10.0), "p")
    gain = F.log10(1 + lift).alias("gain")
    gains = durable_table(pairs.select("key", "spread", F.col("pair_c").alias("c"), gain))
    return durable_table(contexts.select(F.col("before").alias("hash"), F.log10(1 - share).alias("left"))), gains


def as_contexts(words: DataFrame, left: DataFrame) -> DataFrame:
    """Words whose p also holds what they leave, as contexts, to tokens outside their pairs."""
    p = F.col("p") + F.coalesce("left", F.lit(0.0))
    return words.join(left, "hash", "left").withColumn("p", p).drop("left")
