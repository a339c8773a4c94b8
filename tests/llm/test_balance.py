"""Mixing against a plain solution of the dual and the stated bounds."""

import math
from collections import defaultdict

import numpy as np
import pytest

from corpusbundle.llm.balance import mix, mixed
from tests.llm.frames import ODD, words

ROWS = "doc_id long, text string, source string, size string, rate string, ordinal string, _key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", "z", "u") for i, t, s in rows], ROWS)


def corpus(n, seed, sources=("b", "a", "c", None, "d", "é", "")):
    random = np.random.default_rng(seed)
    share = np.array([10, 1, 1, 1, 2, 1, 1][: len(sources)], float)
    picked = random.choice(len(sources), n, p=share / share.sum())
    sizes = np.minimum(random.zipf(1.5, n), 300)
    return [(i, "w " * int(z), sources[int(s)]) for i, (z, s) in enumerate(zip(sizes, picked))]


def plain_targets(total_of, weights=(1, 2, 3), most=3):
    names = sorted(total_of, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = sum(total_of.values()), set()
    while True:
        left = total - sum(most * total_of[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full) or 1
        target = {s: most * total_of[s] if s in full else left * weight[s] / open_weight for s in names}
        above = {s for s in names if target[s] > most * total_of[s]}
        if not above:
            return target
        full |= above


def plain_rates(sizes, target, most=3):
    """Bisection on the dual of one source."""
    x = np.array(sizes, float) / np.mean(sizes)

    def rates(dual):
        return np.minimum(np.exp(np.minimum(dual * x, 700)), most)

    low, high = -1e6, 1e6
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if (rates(middle) * sizes).sum() < target else (low, middle)
    return rates(low)


def by_source(spark, rows, **options):
    got = mix(frame(spark, rows), **options)
    assert got.columns == ["doc_id", "size", "source_size", "target", "rate", "copies", "taken"]
    source = {i: s for i, _, s in rows}
    groups = defaultdict(list)
    for r in got.collect():
        groups[source[r.doc_id]].append(r)
    assert sum(map(len, groups.values())) == len(rows)
    return groups


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_rates_and_copies(spark, seed):
    rows = corpus(500, seed)
    groups = by_source(spark, rows)
    target = plain_targets({s: sum(r.size for r in g) for s, g in groups.items()})
    for source, g in groups.items():
        sizes = np.array([r.size for r in g])
        assert {r.source_size for r in g} == {sizes.sum()}
        assert all(math.isclose(r.target, target[source], rel_tol=1e-12) for r in g)
        assert np.allclose([r.rate for r in g], plain_rates(sizes, target[source]), rtol=1e-4)
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in g)
        assert abs(sum(r.taken for r in g) - target[source]) <= max(np.min(sizes), 0.01 * target[source])
        # Documents of one size have the copies of their rate, up to one each way.
        for size in set(sizes.tolist()):
            assert len({r.copies for r in g if r.size == size}) <= 2


def test_rates_are_exponential_in_size(spark):
    rows = [(i, "w " * (1 + i % 9), "ab"[i % 3 == 0]) for i in range(300)]
    for g in by_source(spark, rows).values():
        logs = {r.size: math.log(r.rate) / r.size for r in g if r.rate < 3}
        assert np.ptp(list(logs.values())) < 1e-9


def test_a_source_above_its_bound_is_taken_whole(spark):
    rows = [(i, "w " * (50 if i else 2), "z" if i else "c") for i in range(40)] + [(99, "w w w", None)]
    groups = by_source(spark, rows)
    assert [r.copies for r in groups[None]] == [3]
    assert plain_targets({"c": 2, "z": 39 * 50, None: 3})[None] == 9
    assert by_source(spark, [(1, "w w", "a"), (2, "w", "a")])["a"][0].copies == 1


def test_reruns_and_layouts_agree(spark):
    rows = corpus(400, 7)
    first = sorted(tuple(r) for r in mix(frame(spark, rows)).collect())
    again = sorted(tuple(r) for r in mix(frame(spark, rows[::-1]).repartition(7)).collect())
    assert first == again


def test_odd_rows(spark):
    rows = [(i, t, "s" if k % 2 else None) for k, (i, t) in enumerate(ODD)]
    got = mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted(r.size for r in got) == sorted(len(words(t)) for _, t, _ in rows)
    assert all(r.taken <= 3 * r.size for r in got)
    assert mix(frame(spark, [])).collect() == []
    blank = mix(frame(spark, [(1, None, "a"), (2, " ", None)])).collect()
    assert [(r.target, r.taken) for r in blank] == [(0.0, 0), (0.0, 0)]


def test_one_size_for_all_documents_of_a_source(spark):
    """One (source, size) holds all rows: the copy that is left over goes by the order of a hash."""
    rows = [(i, "w w", "a") for i in range(200)] + [(1000 + i, "w w w", "b") for i in range(20)]
    groups = by_source(spark, rows)
    for g in groups.values():
        assert abs(sum(r.taken for r in g) - g[0].target) <= g[0].size


def test_mixed_repeats_documents(spark):
    docs = frame(spark, corpus(150, 9))
    copies = {r.doc_id: r.copies for r in mix(docs).collect()}
    got = mixed(docs)
    assert got.columns == [*docs.columns, "copy_no"]
    found = defaultdict(list)
    for r in got.collect():
        found[r.doc_id].append(r.copy_no)
    assert {i: n for i, n in copies.items() if n} == {i: len(c) for i, c in found.items()}
    assert all(sorted(c) == list(range(len(c))) for c in found.values())
