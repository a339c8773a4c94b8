"""Overlaps with test items against a brute-force version of the stated rule."""

import random
from itertools import combinations

import numpy as np

from corpusbundle.llm.decontamination import ItemBlock, _best_stretch, contaminated, masks_of
from tests.llm.frames import documents, passage
from tests.llm.test_filters_and_chat import items


def brute_best(same):
    """Most words alike in any stretch with at least four fifths alike."""
    most = 0
    for i in range(len(same)):
        for j in range(i, len(same)):
            alike = sum(same[i : j + 1])
            if 5 * alike >= 4 * (j + 1 - i):
                most = max(most, alike)
    return most


def test_best_stretch_is_the_longest_that_qualifies():
    rng = random.Random(1)
    for n in range(60):
        for share in (0.5, 0.75, 0.8, 0.9, 1.0):
            same = np.array([rng.random() < share for _ in range(n)], dtype=bool)
            alike, begin, end = _best_stretch(same)
            assert alike == brute_best(same.tolist()) == same[begin:end].sum()
            assert 5 * alike >= 4 * (end - begin)


def changed(text, at):
    return " ".join(f"swap{k}" if k in at else w for k, w in enumerate(text.split()))


def test_changed_passages_from_the_middle_of_an_item(spark):
    text = passage(60, 80)
    middle = " ".join(text.split()[30:47])
    docs, truth = [], set()
    # 7 alike, 1 changed, 3 alike, 1 changed, 5 alike; and other placements that leave 13 of 16 or 15 of 17.
    for k, at in enumerate([(7, 11), (3, 7), (5, 9, 14), (2, 9, 12), (6, 7, 8), (4, 5, 11, 12)]):
        docs.append((k, f"{passage(70 + k, 9)} {changed(middle, at)} {passage(80 + k, 9)}"))
        if brute_best([i not in at for i in range(17)]) >= 13:
            truth.add(k)
    assert truth == {0, 1, 2, 3, 4}
    got = contaminated(documents(spark, docs), items(spark, [(1, text)])).collect()
    assert {r.doc_id for r in got} == truth


def met(alike, masks):
    ones = [[k for k, on in enumerate(m) if on == "1"] for m in masks]
    return any(all(alike[i + k] for k in m) for m in ones for i in range(len(alike) - m[-1]))


def test_masks_meet_every_placement_of_allowed_changes():
    for n in range(1, 17):  # whole items
        for at in combinations(range(n), n - min(13, -(-4 * n // 5))):
            assert met([k not in at for k in range(n)], masks_of(n)), (n, at)
    for n in range(13, 20):  # stretches of longer items
        for at in combinations(range(n), min(n - 13, n // 5)):
            assert met([k not in at for k in range(n)], masks_of(17)), (n, at)


def test_masks_meet_every_longer_stretch():
    masks = masks_of(20)
    # Fewest words changed in a stretch of n that no mask meets, by its last words.
    ones = [sum(1 << len(m) - 1 - k for k, on in enumerate(m) if on == "1") for m in masks]
    keep = (1 << max(map(len, masks)) - 1) - 1
    now, fewest = {0: 0}, [0]
    for _ in range(40):
        after = {}
        for last, changes in now.items():
            for alike in (0, 1):
                word = last << 1 | alike
                if not any(word & m == m for m in ones):
                    state = word & keep
                    after[state] = min(after.get(state, 99), changes + 1 - alike)
        now = after
        fewest.append(min(now.values()))
    # More than a fifth for 20 to 40 words, and so for the sums of such stretches.
    assert all(5 * fewest[n] > n for n in range(20, 41))


def test_short_items_and_changes_at_any_place(spark):
    rng = random.Random(6)
    tests = [(n, passage(n, n)) for n in range(1, 26)] + [(40, ""), (41, None)]
    docs, truth = [], set()
    for n in range(1, 26):
        text = tests[n - 1][1]
        for _ in range(12):
            at = rng.sample(range(n), n // 5)
            docs.append((len(docs), f"{passage(90, 6)} {changed(text, at)} {passage(91, 6)}"))
            most = brute_best([k not in at for k in range(n)])
            if n >= 5 and most >= min(13, -(-4 * n // 5)):
                truth.add((docs[-1][0], n))
        docs.append((len(docs), text.upper()))
        truth.add((docs[-1][0], n))
    got = contaminated(documents(spark, docs), items(spark, tests)).collect()
    assert {(r.doc_id, r.item_id) for r in got} == truth
    assert ItemBlock.of([1], [None]).overlaps(np.zeros(0, np.uint64), np.zeros(1, np.int64)) == []
