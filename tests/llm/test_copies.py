"""Exact and substring deduplication against brute force."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusbundle.llm import substring
from corpusbundle.llm.exact import drop_exact_duplicates, exact_duplicates
from corpusbundle.llm.substring import drop_repeated_windows
from tests.llm.frames import ODD, documents, passage, words


def test_exact_duplicates_of_odd_rows(spark):
    got = exact_duplicates(documents(spark, ODD)).collect()
    groups = defaultdict(list)
    for i, text in ODD:
        groups[text or ""].append(i)
    known = lambda ids: [i for i in ids if i is not None]
    assert len(got) == len(ODD)
    text_of = dict(ODD)
    for row in got:
        if row.doc_id is not None:
            ids = groups[text_of[row.doc_id] or ""]
            assert (row.keep_id, row.group_size) == (max(known(ids)), len(ids))
    assert sum(r.kept for r in got) == len(groups)
    # Of the two rows with one id and text, one stays.
    assert sorted(r.kept for r in got if r.doc_id == 7) == [False, True]


def test_exact_needs_the_whole_text(spark):
    long = "a" * 300
    rows = [(1, long + "x"), (2, long + "y"), (3, long + "x"), (4, long)]
    got = {r.doc_id: (r.keep_id, r.kept) for r in exact_duplicates(documents(spark, rows)).collect()}
    assert got == {1: (3, False), 2: (2, True), 3: (3, True), 4: (4, True)}


def test_dropping_exact_duplicates_keeps_columns(spark):
    docs = documents(spark, ODD)
    kept = drop_exact_duplicates(docs)
    assert kept.schema == docs.schema
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({t or "" for _, t in ODD})
    assert {r._text for r in kept.collect()} == {"z"}


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert exact_duplicates(docs).columns == ["doc_id", "keep_id", "group_size", "kept"]
    assert exact_duplicates(docs).count() == drop_exact_duplicates(docs).count() == 0
    assert drop_repeated_windows(docs).count() == 0


def brute_windows(rows, width=13):
    """(n_words, n_removed, kept text) of each row; null ids come first."""
    key = lambda i: -1 if i is None else i
    first = {}
    for i, text in sorted(rows, key=lambda r: key(r[0])):
        w = words(text)
        for p in range(len(w) - width + 1):
            first.setdefault(tuple(w[p : p + width]), key(i))
    result = []
    for i, text in rows:
        w = words(text)
        keep = [True] * len(w)
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < key(i):
                keep[p : p + width] = [False] * width
        kept = [x for x, k in zip(w, keep) if k]
        result.append((i, len(w), len(w) - len(kept), " ".join(kept)))
    return result


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("width, settled", [(5, 1 << 16), (13, 1 << 16), (13, 0), (13, 40)])
def test_repeated_windows(spark, monkeypatch, width, settled):
    """Also where no string, or the most frequent only, is kept from its bucket."""
    monkeypatch.setattr(substring, "SETTLED", settled)
    shared = passage(9, 25)
    rows = ODD + [(20 + i, f"{passage(50 + i, 6)} {shared} {passage(80 + i, 15)}") for i in range(40)]
    rows += [(90, f"{passage(5, 14)} {passage(5, 14)}"), (91, "the " * 30), (92, "the " * 12), (93, "the " * 13)]
    docs = documents(spark, rows).repartition(7)  # most runs hold one text with the shared passage
    got = [tuple(r) for r in drop_repeated_windows(docs, width=width).collect()]
    assert order(got) == order(brute_windows(rows, width))


def test_windows_of_a_whole_table_by_digest(spark):
    from corpusbundle.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = [tuple(r) for r in QUERIES["op2_substring_dedup"](spark, sf).collect()]
    assert order(got) == order((i, n, lost, sha(text)) for i, n, lost, text in brute_windows(rows))
    assert any(r[2] for r in got)


def test_windows_have_a_least_width(spark):
    with pytest.raises(ValueError):
        drop_repeated_windows(documents(spark, []), width=4)


def test_plain_functions_only(spark):
    plan = exact_duplicates(documents(spark, ODD))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
    assert F.lit(1) is not None
