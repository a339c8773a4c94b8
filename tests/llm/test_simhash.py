"""SimHash fingerprints, grid links and components against brute force."""

import random

import numpy as np
import xxhash

from corpusbundle.llm.components import components
from corpusbundle.llm.simhash import bit_counts, drop_near_duplicates, links, near_duplicates
from tests.llm.frames import ODD, documents, lower, passage, words


def brute_print(text, width=3):
    w = words(lower(text))
    if not w:
        return 0
    grams = [" ".join(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(prints):
    """The smallest member that links reach, for each of the distinct values."""
    parent = {p: p for p in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(parent)
    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in values}


def near_prints(rng):
    """Random values, chains of near ones, a dense ball, and the ends of the range."""
    found = {0, (1 << 64) - 1, 1, 1 << 63, 7, 15}
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 8)):
            found.add(x)
            for _ in range(rng.randrange(1, 5)):
                x ^= 1 << rng.randrange(64)
    centre = rng.getrandbits(64)
    found |= {centre ^ 1 << a ^ 1 << b for a in range(20) for b in range(20)}
    return sorted(found)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def linked_classes(spark, prints, **most):
    frame = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    found = links(frame, **most)
    for a, b in found.collect():
        assert 0 < ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
    roots = {r.node & (1 << 64) - 1: r.root for r in components(found).collect()}
    return {p: roots.get(p, signed(p)) for p in prints}


def same_partition(a, b):
    return len(set(a.values())) == len(set(b.values())) == len({(a[p], b[p]) for p in a})


def test_links_find_all_components(spark):
    prints = near_prints(random.Random(1))
    assert same_partition(linked_classes(spark, prints), brute_classes(prints))


def test_crowded_cells_go_in_blocks(spark):
    prints = near_prints(random.Random(2))
    assert same_partition(linked_classes(spark, prints, most=8), brute_classes(prints))


def test_bit_counts_bound_the_distance():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
    b = a ^ (np.uint64(1) << rng.integers(0, 64, 2000).astype(np.uint64))
    for x, y in ((a, b), (a, a[::-1])):
        bound = np.bitwise_count(bit_counts(x) ^ bit_counts(y))
        assert (bound <= np.bitwise_count(x ^ y)).all()
        for p, q, n in zip(x[:50].tolist(), y[:50].tolist(), bound[:50].tolist()):
            counts = lambda v: [(v >> k & 3).bit_count() for k in range(0, 64, 2)]
            assert n == sum(abs(c - d) for c, d in zip(counts(p), counts(q)))


def test_near_duplicates_of_odd_rows(spark):
    base = passage(1, 400).split()
    rows = ODD + [(30 + i, " ".join(base[:i] + ["other"] + base[i + 1 :])) for i in range(12)]
    got = near_duplicates(documents(spark, rows)).collect()
    prints = [brute_print(t) for _, t in rows]
    root = brute_classes(prints)
    least = {}
    for (i, _), p in zip(rows, prints):
        if i is not None:
            least[root[p]] = min(least.get(root[p], i), i)
    expected = [(i, format(p, "016x"), least.get(root[p])) for (i, _), p in zip(rows, prints)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))

    kept = drop_near_duplicates(documents(spark, rows))
    ids = {i for i, _, c in expected if i is None or i == c}
    assert {r.doc_id for r in kept.collect()} == ids
    assert kept.columns == documents(spark, []).columns


def test_no_rows(spark):
    assert near_duplicates(documents(spark, [])).count() == 0
    assert drop_near_duplicates(documents(spark, [])).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 180)]
    star = [(5, i) for i in range(300, 400)]
    rows = chain + star + [(7, 7), (None, 3), (901, 900)]
    got = {r.node: r.root for r in components(spark.createDataFrame(rows, "a long, b long")).collect()}
    expected = {i: 100 for i in range(100, 181)} | {5: 5} | {i: 5 for i in range(300, 400)} | {900: 900, 901: 900}
    assert got == expected
