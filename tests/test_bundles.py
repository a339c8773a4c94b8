"""Ordered documents against plain joining, and what moves to make them."""

import random

import pytest
from pyspark.sql import functions as F

from corpusbundle.operators import bundles
from corpusbundle.operators.bundles import bundle_parts, with_bins

SCHEMA = "k string, o long, t string, n int"


def plain(rows, sep, part_bytes, skip_blank=False):
    """(key, part_no, n_sections, byte_offset, text) by walking every document."""
    documents = {}
    for k, o, t, _ in rows:
        if t is not None:
            documents.setdefault(k, []).append((o, t))
    result = []
    for k, sections in documents.items():
        if skip_blank and not any(t.strip() for _, t in sections):
            continue
        offset, parts = 0, {}
        for i, (_, t) in enumerate(sorted(sections)):
            piece = sep + t if i else t
            parts.setdefault(offset // part_bytes, []).append((offset, piece))
            offset += len(piece.encode())
        for p, pieces in parts.items():
            result.append((k, p, len(pieces), pieces[0][0], "".join(t for _, t in pieces)))
    return sorted(result, key=str)


def corpus(seed, n=400):
    """One document has half of the rows; some are empty, blank or without a name."""
    r = random.Random(seed)
    names = ["hot"] * 10 + ["a", "b", None, "blank", "ü", "c", "d", "e", "f", "g"]
    rows = []
    for i in range(n):
        k = r.choice(names)
        t = r.choice(["", " \n", "x", "é" * r.randint(1, 9), "words and more\n" * r.randint(0, 4), None])
        rows.append((k, i, " \t" if k == "blank" else t, i))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("sep, part_bytes, fanout, bin_bytes", [("", 64, 32, 1 << 30), ("\n\n", 40, 2, 50), ("--", 7, 3, 200)])
@pytest.mark.parametrize("skip_blank", [False, True])
def test_parts_equal_plain_joining(spark, monkeypatch, sep, part_bytes, fanout, bin_bytes, skip_blank):
    monkeypatch.setattr(bundles, "FANOUT", fanout)
    monkeypatch.setattr(bundles, "BIN_BYTES", bin_bytes)
    rows = corpus(part_bytes)
    got = bundle_parts(spark.createDataFrame(rows, SCHEMA), ["k"], ["o"], "t", sep, part_bytes, skip_blank)
    assert got.columns == ["k", "part_no", "n_sections", "byte_offset", "text"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain(rows, sep, part_bytes, skip_blank)


def test_one_document_without_keys(spark):
    rows = corpus(3)
    got = bundle_parts(spark.createDataFrame(rows, SCHEMA), [], ["o"], "t", "", 100)
    want = [r[1:] for r in plain([("x", *r[1:]) for r in rows], "", 100)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_no_rows(spark):
    for rows in ([], [("a", 1, None, 1)]):
        assert bundle_parts(spark.createDataFrame(rows, SCHEMA), ["k"], ["o"], "t").collect() == []


def test_rows_that_share_a_place_fail(spark):
    rows = spark.createDataFrame([("a", 1, "x", 1), ("a", 1, "y", 2)], SCHEMA)
    with pytest.raises(Exception, match="share their place"):
        bundle_parts(rows, ["k"], ["o"], "t").collect()


def test_text_is_shuffled_once(spark):
    sections = spark.createDataFrame(corpus(5), SCHEMA)
    for skip_blank in (False, True):
        plan = bundle_parts(sections, ["k"], ["o"], "t", "\n", 64, skip_blank)._jdf.queryExecution().executedPlan().toString()
        moved, below_broadcast = 0, None
        for line in plan.splitlines():
            depth = len(line) - len(line.lstrip(" +-:"))
            if below_broadcast is not None and depth <= below_broadcast:
                below_broadcast = None
            if "BroadcastExchange" in line and below_broadcast is None:
                below_broadcast = depth
            moved += "Exchange" in line and below_broadcast is None
        assert moved == 1 and "NestedLoop" not in plan, plan


def test_bins_are_found_by_place(spark, monkeypatch):
    monkeypatch.setattr(bundles, "FANOUT", 3)
    first = [(0, (None, -1)), *((i, (f"k{i:03}", i)) for i in range(1, 40))]
    schema = "_bin long, _first struct<k: string, o: long>, _offset long"
    bounds = spark.createDataFrame([(b, f, b * 10) for b, f in first], schema)
    rows = [(None, -1), (None, 5), ("a", 0), ("k004", 3), ("k004", 4), ("k039", 38), ("k039", 39), ("z", 0)]
    got = with_bins(spark.createDataFrame(rows, "k string, o long"), F.struct("k", "o"), bounds, len(first))
    key = lambda place: (place[0] is not None, place[0] or "", place[1])
    want = {r: max(b for b, f in first if key(f) <= key(r)) for r in rows}
    assert {(r.k, r.o): r._bin for r in got.collect()} == want
    assert {(r.k, r.o): r._offset for r in got.collect()} == {r: b * 10 for r, b in want.items()}
