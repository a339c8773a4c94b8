"""Language-model scores of texts by online logistic context mixing.

What is learned comes from the counts of all training tokens: a vocabulary table, from
it the tables of the bit predictors, then the mixer; and a table of neighbouring tokens
(``successors``). A text's score is a sum over its tokens and over its pairs of neighbours
that are in that table, so every distinct token and pair is scored once. To score texts,
tokens and pairs that are frequent are looked up in tables of bounded size that go to
every task; all others travel as narrow rows and meet the vocabulary and the pairs in
joins. None of them is frequent, so no key of those joins is hot. Texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbundle.llm.common import bounded_batches, durable_table, slot_bitmap, text_of
from corpusbundle.llm.mixing import GATES, INPUTS, POINTS, TOTAL, Mixer, count_bits, learn, log10_probabilities
from corpusbundle.llm.spans import Texts, Words, distinct, lowered, mixed, runs, sums, words
from corpusbundle.llm.successors import as_contexts, by_counts, neighbours, pair_counts, pair_gains, token_hashes

#: Tokens and pairs of the tables that every task holds.
HEAD = 200_000
HEAD_PAIRS = 1_000_000

#: Slots of the largest filter of other pairs (32 MiB of bits), and slots for each pair in it.
MOST_BITS = 28
SLOTS_PER_PAIR = 8

#: Tokens a task counts before it hands them on.
HELD = 200_000

#: Slots of the predictors' tables that travel as one row.
BLOCK = 1 << 16

#: The token that ends each text.
END = b""


def _spans(run: Texts) -> tuple[Texts, Words]:
    texts = lowered(run)
    return texts, words(texts)


def _tokens(texts: Texts, spans: Words) -> tuple[list[bytes], np.ndarray]:
    """(distinct words, number of each word of the run)."""
    codes, first = distinct(texts.data, spans)
    raw = texts.data.tobytes()
    return [raw[a:b] for a, b in zip(spans.start[first].tolist(), spans.end[first].tolist())], codes


def vocabulary(texts: DataFrame) -> DataFrame:
    """(word, c): how often each token occurs in the column ``_text``, the end of each text included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def out() -> pa.RecordBatch:
            arrays = [pa.array(list(held.keys()), pa.binary()), pa.array(list(held.values()), pa.int64())]
            held.clear()
            return pa.RecordBatch.from_arrays(arrays, ["word", "c"])

        for batch in batches:
            for run in runs(batch.column(0)):
                found, codes = _tokens(*_spans(run))
                for word, n in zip(found, np.bincount(codes, minlength=len(found)).tolist()):
                    held[word] = held.get(word, 0) + n
                held[END] = held.get(END, 0) + len(run)
                if len(held) > HELD:
                    yield out()
        if held:
            yield out()

    rows = texts.select("_text").mapInArrow(count, "word binary, c long")
    return rows.groupBy("word").agg(F.sum("c").alias("c"))


class Tables:
    """(zeros, ones) of every slot of the predictors; only packed blocks travel, a Python worker unpacks them once."""

    def __init__(self, packed: dict[int, bytes]):
        self.packed = packed

    @cached_property
    def counts(self) -> np.ndarray:
        table = np.zeros(2 * TOTAL, np.float32)
        while self.packed:
            block, data = self.packed.popitem()
            part = table[block : block + BLOCK]
            part[:] = np.frombuffer(pa.decompress(data, part.nbytes, codec="zstd"), np.float32)
        return table


def _predictors(counted: DataFrame) -> Tables:
    """(zeros, ones) of every slot over the whole vocabulary. One size at every input."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * TOTAL)
        for batch in batches:
            count_bits(batch.column(0).to_pylist(), batch.column(1).to_numpy(), table)
        for block in range(0, len(table), BLOCK):
            part = table[block : block + BLOCK].astype(np.float32)
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part.tobytes()])], ["block", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                part = np.frombuffer(counts, np.float32).astype(np.float64)
                sums[block] = sums[block] + part if block in sums else part
        for block, part in sums.items():
            data = pa.compress(part.astype(np.float32), codec="zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([data])], ["block", "packed"])

    parts = counted.select("word", "c").mapInArrow(count, "block long, counts binary")
    got = parts.repartition("block").mapInArrow(add, "block long, packed binary").toArrow()
    return Tables(dict(zip(got["block"].to_pylist(), got["packed"].to_pylist())))


def _mixer(spark: SparkSession, counted: DataFrame, tables) -> Mixer:
    """One online pass in each task over its tokens; the tasks' mixers are averaged by their tokens."""
    fresh = Mixer.fresh()

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = Mixer.fresh(), 0.0
        for batch in batches:
            n = batch.column(1).to_numpy()
            learn(own, tables.value.counts, batch.column(0).to_pylist(), n)
            seen += float(n.sum())
        if seen:
            values = np.concatenate([own.weights.ravel() * seen, (own.refined - fresh.refined).ravel(), [seen]])
            at = np.arange(len(values))
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(values)], ["at", "value"])

    rows = counted.select("word", "c").mapInArrow(train, "at long, value double")
    got = rows.groupBy("at").agg(F.sum("value").alias("value")).toArrow().sort_by("at")
    values = got["value"].to_numpy()
    if not len(values):
        return fresh
    n = GATES * INPUTS
    weights = values[:n].reshape(GATES, INPUTS) / values[-1]
    return Mixer(weights, fresh.refined + values[n:-1].reshape(256, POINTS, 2))


def _scored(tokens: DataFrame, mixer: Mixer, tables) -> DataFrame:
    """(word, c, log10 probability of its spelling, hash) of each row (word, c)."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(0).to_pylist()
            p = log10_probabilities(mixer, tables.value.counts, found)
            end = np.cumsum([len(w) for w in found], dtype=np.int64)
            start = np.concatenate([[0], end])[:-1]
            names = token_hashes(np.frombuffer(b"".join(found), np.uint8), start, end).view(np.int64)
            columns = [batch.column(0), batch.column(1), pa.array(p), pa.array(names)]
            yield pa.RecordBatch.from_arrays(columns, ["word", "c", "p", "hash"])

    return tokens.select("word", "c").mapInArrow(score, "word binary, c long, p double, hash long")


def _in_head(counted: DataFrame, most: int) -> Column:
    """Whether a row's count ``c`` is among the highest: by levels of counts, ``most`` rows or fewer."""
    level = F.floor(F.log2("c") * 8)
    rows = counted.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    held, least = 0, None
    for row in sorted(rows, key=lambda r: -r.level):
        if held + row.n > most:
            break
        held, least = held + row.n, row.level
    return F.lit(False) if least is None else level >= least


def _pair_filter(rest: DataFrame) -> np.ndarray | None:
    """Bits of the slots that the pairs fall into, sized to their number; none if there are too many."""
    bits = max(6, (SLOTS_PER_PAIR * rest.count() - 1).bit_length())
    if bits > MOST_BITS:
        return None
    found = slot_bitmap(F.col("spread"), rest, bits=bits).toArrow()
    bitmap = np.zeros(1 << bits - 6, np.uint64)
    bitmap[found["_word"].to_numpy()] = found["_mask"].to_numpy().view(np.uint64)
    return bitmap


def _may_hold(bitmap: np.ndarray | None, keys: np.ndarray) -> np.ndarray:
    if bitmap is None:
        return np.ones(len(keys), bool)
    slot = mixed(keys) & np.uint64(64 * len(bitmap) - 1)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def score_texts(
    docs: DataFrame,
    training: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: id, training, n_tokens, n_known, n_bytes, train_tokens, base_score, score.

    Rows for which ``training`` holds are learned from; all rows are scored. Texts are
    lower-cased (A-Z) and read as words and one end token. ``score`` is the model's log10
    probability of the text, and -score / log10(2) / n_bytes its bits per byte (n_bytes
    counts a closing byte for each token). A token's probability depends on the token before
    it, the first one's on the end of a text. ``base_score`` is the add-one unigram score. A
    null or blank text has the end token alone. Without training rows all counts are zero.
    Repeated rows count and are scored each; a null id stays null. Other columns are not
    read; an empty table gives no rows. The mixer is the mean of those of the tasks, so
    ``score`` depends a little on how the training rows are partitioned; the other columns
    do not.
    """
    bounded_batches(docs)
    spark = docs.sparkSession
    source = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(training, F.lit(False)).alias("_training"),
        F.monotonically_increasing_id().alias("_row"),
        text_of(text_col).cast("binary").alias("_text"),
    )
    counted = durable_table(vocabulary(source.filter("_training").select("_text")))
    size = counted.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = size.n or 0, size.v

    tables = spark.sparkContext.broadcast(_predictors(counted))
    mixer = _mixer(spark, counted, tables)
    scored, spelled = by_counts(durable_table(_scored(counted, mixer, tables)), n)
    left, gains = pair_gains(scored, pair_counts(source.filter("_training").select("_text"), _spans, n))
    scored = durable_table(as_contexts(scored, left))
    top = scored.filter((F.col("word") == F.lit(END)) | _in_head(scored, HEAD)).toArrow()
    held = spark.sparkContext.broadcast(
        (top["word"].to_pylist(), np.log10(top["c"].to_numpy() + 1.0), top["p"].to_numpy())
    )
    often = _in_head(gains, HEAD_PAIRS)
    pairs, rest_pairs = gains.filter(often).select("key", "gain").toArrow(), gains.filter(~often)
    held_pairs = spark.sparkContext.broadcast(
        (pairs["key"].to_numpy().view(np.uint64), pairs["gain"].to_numpy(), _pair_filter(rest_pairs))
    )
    # Any training text has an end token; only without one is it spelled here.
    end_p = 0.0 if n else spelled + float(log10_probabilities(mixer, tables.value.counts, [END])[0])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base, p = held.value
        pair_keys, pair_gain, bitmap = held_pairs.value
        pair_index, pair_gain = pd.Index(pair_keys), np.append(pair_gain, 0.0)
        number = {w: i for i, w in enumerate(known)}
        end = number.get(END)
        last_p = end_p if end is None else p[end]
        base, p, one = np.append(base, 0.0), np.append(p, 0.0), np.append(np.ones(len(known), np.int64), 0)
        for batch in batches:
            parts = []
            for run in runs(batch.column(3)):
                texts, spans = _spans(run)
                found, codes = _tokens(texts, spans)
                at = spans.at
                place = np.fromiter((number.get(w, -1) for w in found), np.int64, len(found))[codes]
                rare = np.flatnonzero(place < 0)
                found_base = sums(base[place], at) + (base[end] if end is not None else 0.0)
                found_p = sums(p[place], at) + last_p
                n_found = sums(one[place], at) + (end is not None)
                names = pa.array(found, pa.binary()).take(pa.array(codes[rare]))
                tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, at).astype(np.int32)), names)
                size = np.fromiter((len(w) + 1 for w in found), np.int64, len(found))[codes]
                n_bytes = sums(size, at) + 1
                keys, key_at = neighbours(texts, spans)
                spot = pair_index.get_indexer(keys)
                found_p += sums(pair_gain[spot], key_at)
                apart = np.flatnonzero(spot < 0)
                other = apart[_may_hold(bitmap, keys[apart])]
                others = pa.ListArray.from_arrays(
                    pa.array(np.searchsorted(other, key_at).astype(np.int32)), pa.array(keys[other].view(np.int64))
                )
                parts.append([np.diff(at) + 1, n_bytes, found_base, found_p, n_found, tail, others])
            columns = [pa.array(np.concatenate([x[i] for x in parts])) for i in range(5)]
            lists = [pa.concat_arrays([x[i] for x in parts]) for i in (5, 6)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(3)), *columns, *lists],
                ["_id", "_training", "_row", "n_tokens", "n_bytes", "_base", "_p", "_known", "_tail", "_pairs"],
            )

    kind = source.schema["_id"].dataType.simpleString()
    rows = durable_table(
        source.mapInArrow(
            look_up,
            f"_id {kind}, _training boolean, _row long, n_tokens long, n_bytes long,"
            " _base double, _p double, _known long, _tail array<binary>, _pairs array<bigint>",
        )
    )

    def tails(of: DataFrame) -> DataFrame:
        return of.select("_row", F.explode("_tail").alias("word"))

    # Only texts that were not learned from can hold unknown words.
    strange = tails(rows.filter("not _training")).select("word").join(scored, "word", "left_anti")
    strange = strange.distinct().withColumn("c", F.lit(0).cast("long"))
    strange = _scored(strange, mixer, tables).withColumn("p", F.col("p") + F.lit(spelled))
    lexicon = scored.unionByName(as_contexts(strange, left))
    rest = (
        tails(rows)
        .join(lexicon, "word")
        .groupBy("_row")
        .agg(
            F.sum(F.log10(F.col("c") + 1.0)).alias("_base_rest"),
            F.sum("p").alias("_p_rest"),
            F.count_if(F.col("c") > 0).alias("_known_rest"),
        )
    )
    met = rows.select("_row", F.explode("_pairs").alias("key")).join(rest_pairs, "key")
    more = met.groupBy("_row").agg(F.sum("gain").alias("_gain"))
    zero = F.lit(0)
    return rows.drop("_tail", "_pairs").join(rest, "_row", "left").join(more, "_row", "left").select(
        F.col("_id").alias(id_col),
        F.col("_training").alias("training"),
        "n_tokens",
        (F.col("_known") + F.coalesce("_known_rest", zero)).alias("n_known"),
        "n_bytes",
        F.lit(n).cast("long").alias("train_tokens"),
        (
            F.col("_base") + F.coalesce("_base_rest", zero.cast("double"))
            - F.col("n_tokens") * F.lit(float(np.log10(n + v + 1)))
        ).alias("base_score"),
        (
            F.col("_p") + F.coalesce("_p_rest", zero.cast("double")) + F.coalesce("_gain", zero.cast("double"))
        ).alias("score"),
    )
