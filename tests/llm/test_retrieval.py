"""Ranked search against plain scoring of all pairs."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from corpusbundle.llm import retrieval
from corpusbundle.llm.retrieval import search, weight
from tests.llm.frames import ODD, documents, lower

SF = "/root/testdata/sf0.001"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(text))


def plain(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    result = []
    for item, text in items:
        wanted, scored = Counter(terms(text)), []
        for i, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // n_terms
            score = sum(k * w[t] * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, k in wanted.items() if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        for rank, (score, _, _, i) in enumerate(sorted(scored, key=lambda s: s[:3])[:top], 1):
            result.append((item, rank, i, -score))
    return result


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [(v is None, str(v)) for v in r])


def found(spark, docs, items, **options):
    named = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id string, text string, rank string, score long")
    got = search(documents(spark, docs), named, **options)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return ordered(got.collect())


def test_supplied_tables(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = search(spark.read.parquet(f"{SF}/documents.parquet"), items)
    assert ordered(got.collect()) == ordered(plain(docs, [(r.item_id, r.text) for r in items.collect()]))


@pytest.mark.parametrize("rows, impacts, block", [(3, 1 << 20, 4 << 20), (4096, 25, 4 << 20), (5, 40, 60)])
def test_small_buckets_and_blocks(spark, monkeypatch, rows, impacts, block):
    """Many buckets, so that thresholds prune, and many blocks of items."""
    monkeypatch.setattr(retrieval, "BUCKET_ROWS", rows)
    monkeypatch.setattr(retrieval, "BUCKET_IMPACTS", impacts)
    random = np.random.default_rng(5)
    text = lambda n: " ".join(f"t{int(k)}" for k in random.zipf(1.3, n) % 80)
    docs = [(i, text(int(random.integers(1, 60)))) for i in range(300)]
    items = [(f"i{i}", text(int(random.integers(1, 12)))) for i in range(25)]
    assert found(spark, docs, items, top=4, block_bytes=block) == ordered(plain(docs, items, 4))


def test_pruning_leaves_work_out_and_loses_nothing():
    """Inside a bucket only documents that may reach the threshold are scored."""
    random = np.random.default_rng(6)
    n, n_ids = 400, 30
    dense = random.integers(0, 50, (n, n_ids)) * (random.random((n, n_ids)) < 0.3)
    doc, ids = np.nonzero(dense)
    at = np.searchsorted(doc, np.arange(n + 1))
    lengths = np.sqrt(np.square(dense).sum(axis=1).astype(float))
    bucket = retrieval.Bucket(np.arange(n), np.arange(n), lengths, at, ids, dense[doc, ids].astype(np.int64), n_ids)
    wanted, times = np.array([1, 4, 9, 20, 28]), np.array([1, 2, 1, 1, 3])
    truth = dense[:, wanted] @ times
    looked_at = []
    for least in (1, int(np.sort(truth)[-10]), int(truth.max()), int(truth.max()) + 1):
        docs, scores = bucket.scores(wanted, times, least)
        assert (scores == truth[docs]).all()
        assert set(np.flatnonzero(truth >= least)) <= set(docs.tolist())
        looked_at.append(len(docs))
    assert looked_at[0] > looked_at[1] >= looked_at[2] and looked_at[1] < n // 2


def test_ties_repeated_rows_and_null_ids(spark):
    docs = [(9, "one two"), (3, "one two"), (3, "one two"), (None, "one two"), (7, "two ONE"), (8, "other"), (1, None), (2, "")]
    items = [("a", "One"), ("a", "One"), (None, "two two"), ("b", None), ("c", "absent"), ("d", "!?")]
    assert found(spark, docs, items) == ordered(plain(docs, items))
    assert found(spark, docs, items, top=2) == ordered(plain(docs, items, 2))


def test_odd_and_empty_tables(spark):
    items = [("a", "ünïcode wörds 漢字 one"), ("b", "w" * 5000 + " two three"), ("c", ODD[-1][1])]
    assert found(spark, ODD, items) == ordered(plain(ODD, items))
    assert found(spark, [], items) == [] and found(spark, ODD, []) == []
    assert found(spark, [(1, None), (2, " ")], items) == []


def test_a_term_in_every_document_still_counts(spark):
    docs = [(i, "same " * (i + 1)) for i in range(30)]
    assert weight(30, 30) == math.floor(1000 * math.log(62 / 61)) > 0
    assert found(spark, docs, [("a", "same")]) == ordered(plain(docs, [("a", "same")]))
