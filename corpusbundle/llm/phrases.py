"""Phrase mining with mergeable Misra-Gries summaries.

First pass: each task counts the hashes of all n-grams of a run of text and hands them on as
summaries, one for each hash partition: the n-grams whose hash begins with the partition's bits. A
partition's summaries are merged in one task under a capacity of more than its mass divided
by the threshold: where more counters are held, the next greatest count is taken off all of
them and those at zero go. What is taken off is kept account of and never reaches the
threshold, so every n-gram that does is still held, whatever else shares its partition. There
are as many partitions as the mass of the corpus needs for a capacity of bounded size.

Second pass: only n-grams whose hash survived are counted, by their words. A phrase is looked
at only where both phrases that are one word shorter survive, since they are as frequent.

Both passes see every word; hashes that collide make a survivor more, never a wrong count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbundle.llm.common import bounded_batches, durable_table, text_of
from corpusbundle.llm.spans import Texts, Words, _spans, distinct, hashes, lowered, mixed, ragged, runs
from corpusbundle.operators.ordering import with_positions

#: Longest phrase, in words.
LONGEST = 5

#: Occurrences a phrase must have.
THRESHOLD = 100

#: Counters that a merged summary holds, at most, unless one partition has far more than its share.
COUNTERS = 1 << 20

#: Hashes that a task gathers before it hands on their summaries.
GATHERED = 1 << 21

#: Survivors that the second pass takes to all tasks (eight bytes each); more are joined instead.
SURVIVORS = 1 << 22

#: Bits of a hash that a summary holds beside those of its partition.
_REST = 32

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 32]] = True
_CUT = np.zeros(256, dtype=bool)
_CUT[[10, 11, 12, 13, *b".,;:!?"]] = True

_STEP = np.uint64(0xD6E8FEB86659FD93)


class Grams:
    """The words of some texts of one language, and which n-grams lie inside a piece."""

    def __init__(self, texts: Texts, lang: str):
        texts = lowered(texts)
        data = texts.data
        spans = _spans(~(_BLANK[data] | _CUT[data]), texts.offsets)
        self.n_words = len(spans.start)
        # All words, each with one space after it: a phrase is one span of bytes.
        length = spans.end - spans.start + 1
        self.flat = np.append(data, np.uint8(32))[ragged(spans.start, length)]
        after = np.cumsum(length)
        self.flat[after - 1] = 32
        self.start, self.end = after - length, after - 1
        cuts = np.concatenate([[0], np.cumsum(_CUT[data])])
        text = np.repeat(np.arange(len(texts)), np.diff(spans.at))
        # Words of one piece have equal numbers here: text, then cuts before the word.
        self.piece = cuts[spans.start] + text
        seed = np.frombuffer(lang.encode(), np.uint8)
        own = hashes(seed, np.array([0]), np.array([len(seed)]))[0]
        self.words = mixed(hashes(self.flat, self.start, self.end) ^ own)

    def longer(self, hash_: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first words) of the phrases of ``size`` words that begin with the given shorter ones."""
        fits = at + size <= self.n_words
        at, hash_ = at[fits], hash_[fits]
        whole = self.piece[at + size - 1] == self.piece[at]
        at, hash_ = at[whole], hash_[whole]
        return mixed(hash_ * _STEP + self.words[at + size - 1]), at

    def all(self, longest: int) -> Iterator[np.ndarray]:
        hash_, at = self.words, np.arange(self.n_words)
        yield hash_
        for size in range(2, longest + 1):
            hash_, at = self.longer(hash_, at, size)
            yield hash_

    def surviving(self, longest: int, survives) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(hashes, first words, size) of the phrases that survive, with all of their own phrases."""
        hash_, at = self.words, np.arange(self.n_words)
        for size in range(1, longest + 1):
            if size > 1:
                held = np.zeros(self.n_words + 1, dtype=bool)
                held[at] = True
                hash_, at = self.longer(hash_, at, size)
                tail = held[at + 1]
                hash_, at = hash_[tail], at[tail]
            good = survives(hash_)
            hash_, at = hash_[good], at[good]
            yield hash_, at, size


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, Grams]]:
    """Columns (lang, text), neither with nulls."""
    langs = batch.column(0)
    for lang in pc.unique(langs).to_pylist():
        column = batch.column(1).filter(pc.equal(langs, lang))
        for texts in runs(column):
            yield lang, Grams(texts, lang)


# Summaries.


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with the sum of their counts (one each if none are given)."""
    if counts is None:
        keys, found = np.unique(keys, return_counts=True)
        return keys, found.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Keys that occur once, then the others with their counts."""
    once = counts == 1
    n = np.array([once.sum()], np.uint32)
    parts = (n, keys[once].astype(np.uint32), keys[~once].astype(np.uint32), counts[~once].astype(np.uint32))
    return b"".join(p.tobytes() for p in parts)


def unpacked(summary: bytes) -> tuple[np.ndarray, np.ndarray]:
    values = np.frombuffer(summary, np.uint32).astype(np.int64)
    once, rest = int(values[0]), (len(values) - 1 - int(values[0])) // 2
    keys = values[1 : 1 + once + rest]
    return keys, np.concatenate([np.ones(once, np.int64), values[1 + once + rest :]])


class Summary:
    """A Misra-Gries summary: ``keys`` with ``counts``, each at most ``lost`` below the truth."""

    def __init__(self, capacity: int, threshold: int):
        self.capacity, self.threshold = capacity, threshold
        self.keys = self.counts = np.zeros(0, np.int64)
        self.lost = 0
        self._waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self._n = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self._waiting.append((keys, counts))
        self._n += len(keys)
        if self._n > self.capacity:
            self.merge()

    def merge(self) -> None:
        held = [(self.keys, self.counts), *self._waiting]
        self.keys, self.counts = counted(*(np.concatenate(c) for c in zip(*held)))
        self._waiting, self._n = [], 0
        over = len(self.keys) - self.capacity
        if over <= 0:
            return
        less = int(np.partition(self.counts, over - 1)[over - 1])
        # Never as much as the threshold: beyond that the summary grows instead.
        less = min(less, self.threshold - 1 - self.lost)
        left = self.counts > less
        self.keys, self.counts = self.keys[left], self.counts[left] - less
        self.lost += less

    def frequent(self) -> np.ndarray:
        """Every key that occurs ``threshold`` times, and some that occur less often."""
        self.merge()
        return self.keys[self.counts + self.lost >= self.threshold]


def _summaries(source: DataFrame, longest: int, bits: int) -> DataFrame:
    """(part, summary): the n-grams of a run of texts whose hash begins with the bits of ``part``."""
    shift = np.uint64(64 - bits - _REST)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: list[np.ndarray] = []
        n = 0

        def out() -> pa.RecordBatch:
            keys, counts = counted(np.concatenate(gathered) >> shift)
            part = (keys >> np.uint64(_REST)).astype(np.int64)
            parts, first = np.unique(part, return_index=True)
            ends = [*first[1:], len(keys)]
            rest = keys & np.uint64(0xFFFFFFFF)
            found = [packed(rest[a:b], counts[a:b]) for a, b in zip(first, ends)]
            return pa.RecordBatch.from_arrays([pa.array(parts), pa.array(found, pa.binary())], ["part", "summary"])

        for batch in batches:
            for _, grams in _by_lang(batch):
                for hash_ in grams.all(longest):
                    gathered.append(hash_)
                    n += len(hash_)
                if n >= GATHERED:
                    yield out()
                    gathered, n = [], 0
        if n:
            yield out()

    return source.mapInArrow(task, "part long, summary binary")


def _survivors(summaries: DataFrame, capacity: int, threshold: int) -> DataFrame:
    """(key): the first bits of the hash of every n-gram that may reach the threshold."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, summary = None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(summary.frequent() + (now << _REST))], ["key"])

        for batch in batches:
            parts = batch.column(0).to_pylist()
            for part, blob in zip(parts, batch.column(1)):
                if part != now:
                    if summary is not None:
                        yield out()
                    now, summary = part, Summary(capacity, threshold)
                summary.add(*unpacked(blob.as_py()))
        if summary is not None:
            yield out()

    placed = summaries.repartition("part").sortWithinPartitions("part")
    return durable_table(placed.mapInArrow(task, "key long"))


def layout(mass: int, threshold: int, tasks: int, counters: int) -> tuple[int, int]:
    """(bits, capacity): 2**bits partitions, each with twice the counters that its share of the mass needs."""
    needed = 2 * mass // threshold + 1
    parts = max(tasks, -(-needed // counters))
    bits = max((parts - 1).bit_length(), 1)
    return bits, -(-needed // (1 << bits)) + 1


# Exact counts.


def _phrases(grams: Grams, longest: int, survives) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(phrases, sizes, keys, counts) of the surviving n-grams of a run."""
    found = list(grams.surviving(longest, survives))
    keys = np.concatenate([h for h, _, _ in found])
    at = np.concatenate([a for _, a, _ in found])
    sizes = np.concatenate([np.full(len(a), s) for _, a, s in found])
    spans = Words(grams.start[at], grams.end[at + sizes - 1], np.array([0, len(at)]))
    codes, first = distinct(grams.flat, spans)
    raw = grams.flat.tobytes()
    texts = [raw[a:b] for a, b in zip(spans.start[first].tolist(), spans.end[first].tolist())]
    counts = np.bincount(codes, minlength=len(first)).astype(np.int64)
    return pa.array(texts, pa.binary()), sizes[first].astype(np.int64), keys[first], counts


def _counts(source: DataFrame, longest: int, bits: int, survivors: DataFrame, most: int) -> DataFrame:
    """(lang, phrase, size, f) of all n-grams that may be frequent."""
    n = survivors.count()
    shift = np.uint64(64 - bits - _REST)
    few = n <= most
    if few:
        table = survivors.toPandas()["key"].to_numpy(np.int64).copy()
        table.sort()
        held = source.sparkSession.sparkContext.broadcast(table)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if few:
            keys = held.value
            slot = np.zeros(1 << max(int(len(keys)).bit_length() + 3, 10), dtype=bool)
            mask = np.int64(len(slot) - 1)
            slot[keys & mask] = True

            def survives(hash_: np.ndarray) -> np.ndarray:
                key = (hash_ >> shift).astype(np.int64)
                good = slot[key & mask]
                near = key[good]
                place = np.minimum(np.searchsorted(keys, near), len(keys) - 1)
                good[good] = keys[place] == near
                return good
        else:

            def survives(hash_: np.ndarray) -> np.ndarray:
                return np.ones(len(hash_), dtype=bool)

        for batch in batches:
            for lang, grams in _by_lang(batch):
                phrase, size, key, count = _phrases(grams, longest, survives)
                key = pa.array((key >> shift).astype(np.int64))
                langs = pa.array([lang] * len(phrase), pa.string())
                columns = [langs, phrase.cast(pa.string()), pa.array(size), key, pa.array(count)]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "size", "key", "f"])

    if n == 0:
        return source.sparkSession.createDataFrame([], "lang string, phrase string, size long, f long")
    found = source.mapInArrow(task, "lang string, phrase string, size long, key long, f long")
    if few:
        found = found.drop("key")
        return found.groupBy("lang", "phrase", "size").agg(F.sum("f").alias("f"))
    # Too many for every task: what a task has counted meets the survivors in a shuffle.
    summed = found.groupBy("key", "lang", "phrase", "size").agg(F.sum("f").alias("f"))
    return summed.join(survivors, "key", "left_semi").drop("key")


# Collocations.


def _words(column: str) -> Column:
    return F.split(column, " ", -1)


def _part(words: str, first: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, first, size), " ")


def phrase_counts(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    longest: int = LONGEST,
    text_col: str = "text",
    lang_col: str = "lang",
    counters: int = COUNTERS,
    survivors: int = SURVIVORS,
) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, size, f), (lang, n)): every n-gram that occurs ``threshold`` times, and all words by language.

    See ``mine_phrases`` for what a word and a phrase are. ``counters`` bounds the memory of a
    merged summary, ``survivors`` what is sent to all tasks; neither changes the result.
    """
    bounded_batches(docs)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    source = docs.select(lang.alias("lang"), text_of(text_col).cast("binary").alias("_text"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for batch in batches:
            for name, grams in _by_lang(batch):
                mass = grams.n_words
                for size in range(2, longest + 1):
                    last = grams.piece[size - 1 :]
                    mass += int((last == grams.piece[: len(last)]).sum()) if len(last) else 0
                held = found.setdefault(name, [0, 0])
                held[0] += grams.n_words
                held[1] += mass
        n, mass = (pa.array([v[i] for v in found.values()], pa.int64()) for i in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), n, mass], ["lang", "n", "mass"])

    by_lang = durable_table(
        source.mapInArrow(totals, "lang string, n long, mass long")
        .groupBy("lang")
        .agg(F.sum("n").alias("n"), F.sum("mass").alias("mass"))
    )
    mass = by_lang.agg(F.sum("mass")).first()[0] or 0
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bits, capacity = layout(mass, threshold, tasks, counters)
    kept = _survivors(_summaries(source, longest, bits), capacity, threshold)
    counts = _counts(source, longest, bits, kept, survivors).filter(F.col("f") >= threshold)
    return durable_table(counts), by_lang.select("lang", "n")


def mine_phrases(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    longest: int = LONGEST,
    top: int = 2000,
    percent: int = 100,
    text_col: str = "text",
    lang_col: str = "lang",
    **bounds: int,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Texts are lower-cased (A-Z), cut into pieces at ``. , ; : ! ?`` and line ends, and pieces
    into words at blanks and tabs. A phrase is two or more words that follow each other in a
    piece at least ``threshold`` times (a). Cut after k words its score is
    floor(1000 a n / (l r)), l and r the occurrences of its two parts, n those of all words;
    the lowest score counts, of equal ones that of the smallest k. Phrases inside a longer
    one with ``percent`` of their occurrences or more are left out. Ranks go by score, a (both
    descending) and phrase.

    A null text is empty, a null language is ``und``; other columns are not read, repeated rows
    count each. An empty table gives no rows.
    """
    counts, by_lang = phrase_counts(docs, threshold, longest, text_col, lang_col, **bounds)
    candidates = durable_table(counts.filter("size > 1").withColumn("_words", _words("phrase")))

    # Phrases inside a longer one, wherever it is nearly as frequent.
    inner = candidates.filter("size > 2").select(
        "lang",
        F.col("f").alias("_longer"),
        F.explode(F.sequence(F.lit(2), (F.col("size") - 1).cast("int"))).alias("_size"),
        "size",
        "_words",
    )
    inner = inner.withColumn("_first", F.explode(F.sequence(F.lit(1), (F.col("size") - F.col("_size") + 1).cast("int"))))
    covered = (
        inner.select("lang", _part("_words", F.col("_first"), F.col("_size")).alias("phrase"), "_longer")
        .groupBy("lang", "phrase")
        .agg(F.max("_longer").alias("_longer"))
    )
    covering = F.coalesce(F.expr(f"100 * _longer >= {int(percent)} * f"), F.lit(False))
    alone = candidates.join(covered, ["lang", "phrase"], "left").filter(~covering)

    cuts = alone.select(
        "lang", "phrase", F.col("f").alias("a"), "size", "_words",
        F.explode(F.sequence(F.lit(1), (F.col("size") - 1).cast("int"))).alias("k"),
    ).select(
        "lang", "phrase", "a", "k",
        _part("_words", 1, F.col("k")).alias("_left"),
        _part("_words", F.col("k") + 1, (F.col("size") - F.col("k")).cast("int")).alias("_right"),
    )
    left = counts.select("lang", F.col("phrase").alias("_left"), F.col("f").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("_right"), F.col("f").alias("r"))
    # A language has one row, so this side grows with their number only.
    measured = cuts.join(left, ["lang", "_left"]).join(right, ["lang", "_right"]).join(by_lang, "lang")
    wide = {c: f"cast({c} as decimal(17,0))" for c in ("a", "n", "l", "r")}
    score = F.expr(f"(cast(1000 as decimal(4,0)) * {wide['a']} * {wide['n']}) div ({wide['l']} * {wide['r']})")
    best = (
        measured.withColumn("score", score)
        .groupBy("lang", "phrase", "a", "n")
        .agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
        .select("lang", "phrase", "a", "_cut.l", "_cut.r", "n", "_cut.score")
    )
    ordered = durable_table(best.withColumns({"_score": -F.col("score"), "_a": -F.col("a")}))
    ranked = with_positions(ordered, ["lang"], ["_score", "_a", "phrase"]).filter(F.col("ordinal") < top)
    return ranked.select(
        "lang", (F.col("ordinal") + 1).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )
