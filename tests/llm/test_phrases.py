"""Phrase mining against plain counting, and the guarantee of its summaries."""

import re
from collections import Counter

import numpy as np
import pytest

from corpusbundle.llm.phrases import Summary, counted, layout, mine_phrases, packed, phrase_counts, unpacked
from tests.llm.frames import ODD, lower

ROWS = "doc_id long, text string, lang string, phrase string, f string, part string, key string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "p", "q", "r", "s") for i, (t, g) in enumerate(rows)], ROWS)


def plain_counts(rows):
    counts, words = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        found = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            held = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(held)
            found.update(tuple(held[i : i + k]) for k in range(1, 6) for i in range(len(held) - k + 1))
    return counts, words


def plain(rows, threshold, top=2000, percent=100):
    counts, words = plain_counts(rows)
    result = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= threshold}
        inside = {
            p[i:j]
            for p, a in held.items()
            for i in range(len(p))
            for j in range(i + 2, len(p) + 1)
            if j - i < len(p) and 100 * a >= percent * held[p[i:j]]
        }
        scored = []
        for p, a in held.items():
            if p not in inside:
                score, k = min((1000 * a * words[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            result.append((lang, rank, phrase.decode(), -a, l, r, words[lang], -score))
    return sorted(result)


def mined(spark, rows, threshold, **options):
    return sorted(tuple(r) for r in mine_phrases(frame(spark, rows), threshold, **options).collect())


def corpus(n, seed=1):
    """Texts of few words, with phrases that recur, in two languages and none."""
    random = np.random.default_rng(seed)
    langs = ["aa", "aa", "aa", "bb", None]
    rows = []
    for i in range(n):
        words = [f"w{int(k)}" for k in random.zipf(1.4, 40) % 50]
        at = int(random.integers(0, 30))
        words[at : at + 4] = ["Now", "and", "THEN", "again"][: int(random.integers(2, 5))]
        words[int(random.integers(0, 38))] += random.choice([",", ".", "!", "\n", " \t", ""])
        rows.append((" ".join(words), langs[i % 5]))
    return rows


@pytest.mark.parametrize("options", [{}, {"counters": 40}, {"survivors": 0}, {"counters": 60, "survivors": 3}])
def test_equals_plain_counting_whatever_the_bounds(spark, options):
    rows = corpus(120)
    assert mined(spark, rows, 9, **options) == plain(rows, 9)


def test_top_percent_and_ties(spark):
    rows = corpus(120, 2)
    assert mined(spark, rows, 6, top=5) == plain(rows, 6, top=5)
    assert mined(spark, rows, 6, percent=60) == plain(rows, 6, percent=60)
    tied = [("x y. z q. a b c", "aa")] * 4
    assert mined(spark, tied, 4) == plain(tied, 4)
    assert [r[2] for r in mined(spark, tied, 4)] == ["a b c", "x y", "z q"]


def test_odd_rows(spark):
    rows = [(t, None) for _, t in ODD] + [("ÉÀ éa ÉÀ éa\x0b ÉÀ éa", ""), ("x  \t y\x00z x y\x00z", "")] * 2
    assert mined(spark, rows, 2) == plain(rows, 2)
    assert mined(spark, [], 1) == []
    assert mined(spark, [(None, "aa"), ("", "aa"), (" .,; \n", None)], 1) == []
    long_text = " ".join(f"v{i % 7}" for i in range(200_000))
    assert mined(spark, [(long_text, "aa")], 100) == plain([(long_text, "aa")], 100)


def test_all_words_and_parts_are_counted(spark):
    rows = corpus(60, 3)
    counts, by_lang = phrase_counts(frame(spark, rows), 5)
    found, words = plain_counts(rows)
    assert {(r.lang, r.n) for r in by_lang.collect()} == set(words.items())
    assert {(r.lang, r.phrase, r.f) for r in counts.collect()} == {
        (lang, " ".join(p), n) for lang, f in found.items() for p, n in f.items() if n >= 5
    }


def test_a_summary_keeps_every_frequent_key():
    random = np.random.default_rng(4)
    for capacity in (20, 50, 200):
        summary, truth = Summary(capacity, 30), Counter()
        for _ in range(60):
            keys, counts = counted(np.concatenate([random.integers(0, 4000, 150), random.integers(0, 9, 10)]))
            truth.update(dict(zip(keys.tolist(), counts.tolist())))
            summary.add(keys, counts)
        kept = set(summary.frequent().tolist())
        assert {k for k, n in truth.items() if n >= 30} <= kept
        assert summary.lost < 30
        for key, count in zip(summary.keys.tolist(), summary.counts.tolist()):
            assert count <= truth[key] <= count + summary.lost


def test_capacity_exceeds_the_share_of_the_mass():
    for mass in (0, 1, 10**4, 10**9, 10**13):
        bits, capacity = layout(mass, 100, 8, 1 << 20)
        assert capacity << bits > mass // 100
        assert capacity <= (1 << 20) + 1
    # Memory stays bounded under the mass that a partition can be given.
    summary = Summary(1000, 100)
    for start in range(0, 90_000, 500):
        summary.add(np.arange(start, start + 500), np.ones(500, np.int64))
        assert len(summary.keys) <= 1000 and summary._n <= 1000


def test_summaries_are_read_as_written():
    keys, counts = np.array([0, 5, 7, 2**32 - 1]), np.array([1, 3, 1, 70_000])
    got = dict(zip(*(a.tolist() for a in unpacked(packed(keys, counts)))))
    assert got == {0: 1, 5: 3, 7: 1, 2**32 - 1: 70_000}


def test_scores_beyond_64_bits(spark):
    """1000 a n passes 2**63 here, taken as the expression of the query on given counts."""
    a, n, l, r = 10**14, 10**15, 10**14, 10**15
    expr = "(cast(1000 as decimal(4,0)) * cast({0}L as decimal(17,0)) * cast({1}L as decimal(17,0))) div (cast({2}L as decimal(17,0)) * cast({3}L as decimal(17,0)))"
    assert spark.sql("select " + expr.format(a, n, l, r)).first()[0] == 1000 * a * n // (l * r)
