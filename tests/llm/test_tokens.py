"""Token counts and packing against the tokenizer library."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusbundle.llm.packing import best_filling, pack, plan_windows
from corpusbundle.llm.token_counts import _encoded, count_tokens, read_cache
from corpusbundle.llm.vocabulary import Vocabulary, version_of
from tests.llm.frames import ODD, documents

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
PIECES = public_tokenizers.path("piece_bpe_32k.model")

STRANGE = ODD + [
    (40, "a  b   c \n d"),
    (41, "  lead and trail  "),
    (42, "x <|endoftext|>  y<|startoftext|> z<|endoftext|>"),
    (43, "it's we'll\n\n\tyou're"),
    (44, "é é ́x ΑΣ Σ"),
    (45, "a\x85 b  c　d \x1d e"),
]


def library_ids(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 'sS.,1\n\t\r  \x1c\x85éß漢🙂"), max_size=25), max_size=6))
@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_are_those_of_the_library(path, texts):
    encoder, model = _loaded(path)
    column = pa.array([t.encode() for t in texts], pa.binary())
    got = [ids[a:b].tolist() for ids, at in encoder.texts(column) for a, b in zip(at, at[1:])]
    assert got == [model.encode(t, add_special_tokens=False).ids for t in texts]


_models = {}


def _loaded(path):
    if path not in _models:
        _models[path] = Vocabulary(path).encoder(), Tokenizer.from_file(path)
    return _models[path]


def test_a_small_memory_gives_the_same_ids(monkeypatch):
    import corpusbundle.llm.vocabulary as vocabulary

    column = pa.array([(t or "").encode() for _, t in STRANGE], pa.binary())
    expected = _loaded(BYTES)[0].counts(column).tolist()
    monkeypatch.setattr(vocabulary, "REMEMBERED", 3)
    assert Vocabulary(BYTES).encoder().counts(column).tolist() == expected


@pytest.mark.parametrize("path", [WORDS, PIECES])
def test_counts_and_cache(spark, tmp_path, path):
    cache = f"file://{tmp_path}/cache"
    docs = documents(spark, STRANGE)
    if path == PIECES:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t or ""))
    else:
        count = lambda t: len(library_ids(path, t))
    expected = sorted(str((i, len((t or "").encode()), count(t))) for i, t in STRANGE)
    assert sorted(str(tuple(r)) for r in count_tokens(docs, path, cache).collect()) == expected
    stored = read_cache(docs, cache, version_of(path))
    n = len({t or "" for _, t in STRANGE})
    assert stored.count() == n
    # A second run finds all texts and appends none; a further text is appended.
    more = documents(spark, [*STRANGE, (99, "further text")])
    assert count_tokens(docs, path, cache).count() == len(STRANGE)
    assert spark.read.parquet(cache).count() == n
    assert count_tokens(more, path, cache).count() == len(STRANGE) + 1
    assert spark.read.parquet(cache).count() == n + 1
    assert read_cache(docs, cache, "another version").count() == 0


@pytest.mark.parametrize("bounds", [{}, {"exact": 0}, {"exact": 0, "most_bits": 2}])
def test_each_missing_text_is_encoded_once(spark, bounds):
    """Repeated, stored and single texts, by keys, by a bitmap, and without a filter."""
    texts = [f"text number {k}" for k in range(300)] + ["copy a", "copy b"] * 40 + [f"stored {k}" for k in range(60)] * 2
    docs = spark.createDataFrame([(t,) for t in texts], "_text string").repartition(5)
    rows = docs.groupBy("_text").count().select(
        F.unhex(F.sha2("_text", 256)).alias("digest"), F.col("count").alias("_rows"),
        F.when(F.col("_text").startswith("stored"), F.lit(3)).alias("_stored"),
    )
    groups = spark.createDataFrame(rows.collect(), rows.schema)
    got = _encoded(docs, groups, WORDS, "v", **bounds).collect()
    want = {hashlib.sha256(t.encode()).digest(): len(library_ids(WORDS, t)) for t in texts if "stored" not in t}
    assert sorted((bytes(r.digest), r.n_tokens) for r in got) == sorted(want.items())


def test_counts_of_no_rows(spark, tmp_path):
    assert count_tokens(documents(spark, []), WORDS, f"file://{tmp_path}/cache").count() == 0


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=7), st.integers(0, 60))
def test_best_filling_is_the_closest(counts, room):
    reach = {0}
    for length, n in counts.items():
        reach |= {r + length * k for r in reach for k in range(n + 1)}
    best, chosen = best_filling(counts, room)
    assert best == max(r for r in reach if r <= room)
    assert sum(k * v for k, v in chosen.items()) == best
    assert all(v <= counts[k] for k, v in chosen.items())


def test_a_plan_places_every_document_once():
    rng = np.random.default_rng(3)
    counts = {int(k): int(n) for k, n in zip(rng.choice(np.arange(1, 64), 30, False), rng.integers(1, 500, 30))}
    plan = plan_windows(counts, 64)
    used = defaultdict(int)
    fill = defaultdict(list)
    for length, rank, copies, sequence, offset in zip(plan.length, plan.rank, plan.copies, plan.sequence, plan.offset):
        nxt = min((r for l, r in zip(plan.length, plan.rank) if l == length and r > rank), default=counts[length])
        for q in range(rank, nxt):
            nth = q - rank
            fill[sequence + nth // copies].append((offset + nth % copies * length, length))
            used[length] += 1
    assert dict(used) == counts and len(fill) == plan.sequences
    for pieces in fill.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64


def test_packing_round_trip(spark):
    docs = documents(spark, STRANGE * 3)
    rows = pack(docs, BYTES, capacity=256).collect()
    ids = {i: library_ids(BYTES, t) + [1] for i, t in STRANGE if i is not None}
    by_sequence = defaultdict(list)
    tokens = 0
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        tokens += r.length
        if r.doc_id is not None:
            own = ids[r.doc_id]
            piece = np.array(own[r.start : r.start + r.length], "<u4").tobytes()
            assert (r.doc_tokens, r.ids_crc32) == (len(own), zlib.crc32(piece))
    assert tokens == 3 * sum(len(library_ids(BYTES, t)) + 1 for _, t in STRANGE)
    filled = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 256
        filled += 256
    assert filled - tokens <= 0.01 * tokens
    assert pack(documents(spark, []), BYTES).count() == 0
