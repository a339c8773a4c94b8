"""Language-model scores and the quality classifier."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusbundle.llm.language_model import score_texts
from corpusbundle.llm.mixing import TOTAL, Mixer, count_bits, learn, log10_probabilities
from corpusbundle.llm.quality import _descend, features, fit, in_fold, train, with_scores
from corpusbundle.llm.queries import QUERIES
from corpusbundle.llm.spans import runs
from tests.llm.frames import ODD, documents, lower, passage, words

SF = "/root/testdata/sf0.001"


def tokens(text):
    return words(lower(text)) + [""]


def brute_base(rows, training):
    counts = Counter(t for (_, text), own in zip(rows, training) if own for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    result = []
    for i, text in rows:
        own = tokens(text)
        base = sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)
        result.append((i, len(own), sum(counts[t] > 0 for t in own), n, base))
    return result


def same_scores(got, expected):
    key = lambda r: str(r[:4])
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    expected = sorted(expected, key=key)
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    np.testing.assert_allclose([g[4] for g in got], [e[4] for e in expected], rtol=1e-9)


@pytest.mark.parametrize("head", [200_000, 3])
def test_base_scores_of_odd_rows(spark, monkeypatch, head):
    """Also where nearly all tokens go through the join."""
    import corpusbundle.llm.language_model as model

    monkeypatch.setattr(model, "HEAD", head)
    rows = [r for r in ODD if r[0] != 12] + [(30, "new words only here"), (31, "One more one")]
    training = [i is not None and i % 2 == 1 for i, _ in rows]
    got = score_texts(documents(spark, rows), F.col("doc_id") % 2 == 1).collect()
    same_scores(got, brute_base(rows, training))
    # Equal tokens have equal scores, and a score is a probability.
    by_text = {}
    for r in got:
        assert r.score < 0
    for r in got:
        text = dict(rows)[r.doc_id] if r.doc_id is not None else None
        if r.doc_id is not None:
            assert by_text.setdefault(" ".join(tokens(text)), r.score) == pytest.approx(r.score, rel=1e-9)


def test_base_scores_of_a_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    got = QUERIES["op7_lm_scores"](spark, SF).collect()
    same_scores(got, brute_base(rows, [not h for h in held]))
    assert {r.doc_id: r.held_out for r in got} == {i: h for (i, _), h in zip(rows, held)}
    # Held-out text costs far fewer bits a byte than eight, and less than bytes drawn by their frequency.
    bits = -sum(r.score for r in got if r.held_out) / math.log10(2) / sum(r.n_bytes for r in got if r.held_out)
    letters = Counter(b for _, t in rows for b in (" ".join(tokens(t)) + "\n").encode())
    total = sum(letters.values())
    assert bits < -sum(n / total * math.log2(n / total) for n in letters.values())


def brute_pairs(texts):
    """(pairs of neighbouring tokens, each token as a context), the end of a text before the next one's first."""
    pairs = Counter()
    for text in texts:
        own = [b"", *(t.encode() for t in tokens(text))]
        pairs.update(zip(own, own[1:]))
    return pairs


def pair_key(pair):
    from corpusbundle.llm.successors import token_hashes

    a, b = (int(token_hashes(np.frombuffer(t or b"x", np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in pair)
    return np.array([a << 32 | b], np.uint64).view(np.int64)[0]


@pytest.mark.parametrize("held, row, block", [(1 << 22, 1 << 10, 1 << 21), (50, 3, 40)])
def test_counted_pairs(spark, monkeypatch, held, row, block):
    """Also where tasks hand on few pairs at once and there are many blocks."""
    import corpusbundle.llm.successors as successors
    from corpusbundle.llm.language_model import _spans

    for name, value in (("HELD", held), ("ROW", row), ("BLOCK", block)):
        monkeypatch.setattr(successors, name, value)
    texts = [t or "" for _, t in ODD] + [passage(k % 5, 40) for k in range(20)] + ["so so so so so so", "", ""]
    frame = spark.createDataFrame([(t.encode(),) for t in texts], "_text binary").repartition(3)
    n = sum(len(tokens(t)) for t in texts)
    got = successors.pair_counts(frame, _spans, n).collect()
    expected = {pair_key(p): c for p, c in brute_pairs(texts).items() if c >= successors.LEAST}
    assert {r.key: r.c for r in got} == expected and len(got) == len(expected) > 30
    assert len({r.spread for r in got}) == len(got)


def test_gains_make_a_distribution(spark):
    """Against a plain version; what pairs add and what contexts leave sum to one over the known words."""
    from corpusbundle.llm.language_model import _spans
    from corpusbundle.llm.successors import pair_counts, pair_gains, token_hashes

    texts = [passage(k % 7, 30) for k in range(40)]
    pairs, count = brute_pairs(texts), Counter(t.encode() for x in texts for t in tokens(x))
    n = sum(count.values())
    p = {w: c / n for w, c in count.items()}
    name = {w: int(token_hashes(np.frombuffer(w or b"x", np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in count}
    rows = [(w, c, math.log10(p[w]), name[w]) for w, c in count.items()]
    scored = spark.createDataFrame(rows, "word binary, c long, p double, hash long")
    frame = spark.createDataFrame([(t.encode(),) for t in texts], "_text binary")
    left, gains = pair_gains(scored, pair_counts(frame, _spans, n))
    left = {r.hash: r.left for r in left.collect()}
    gain = {r.key: r.gain for r in gains.collect()}
    kept = {q: c for q, c in pairs.items() if c >= 4}
    assert set(gain) == {pair_key(q) for q in kept} and set(left) == {name[a] for a, _ in kept}
    for a, b in kept:
        share = 1 - 10 ** left[name[a]]
        mix = share * kept[a, b] / count[a] + (1 - share) * p[b]
        assert math.log10(p[b]) + left[name[a]] + gain[pair_key((a, b))] == pytest.approx(math.log10(mix), rel=1e-9)
    for a in {a for a, _ in kept}:
        whole = sum(p[b] * 10 ** (left[name[a]] + gain.get(pair_key((a, b)), 0.0)) for b in count)
        assert 0.2 < whole <= 1 + 1e-9


def test_shares_follow_the_cases():
    from corpusbundle.llm.successors import CELLS, fit_shares

    rng = np.random.default_rng(3)
    gate, cell = rng.integers(0, 3, 4000), rng.integers(0, CELLS, 4000)
    true = 1 / (1 + np.exp(-((cell - CELLS // 2) / 4.0 + gate - 1)))
    taken = rng.random(4000) < true
    gain = np.where(taken, 8.0, -np.inf)
    share = fit_shares(gate, cell, gain, np.full(4000, 100.0)).share
    seen = np.unique(gate * CELLS + cell)
    expected = np.array([taken[gate * CELLS + cell == k].mean() for k in seen])
    assert np.abs(share.ravel()[seen] - expected).max() < 0.05
    # A cell without cases gets what its gate says.
    none = fit_shares(np.zeros(0, int), np.zeros(0, int), np.zeros(0), np.zeros(0)).share
    assert ((none > 0) & (none < 1)).all()


@pytest.mark.parametrize("head, most_bits", [(1_000_000, 28), (2, 28), (2, 3)])
def test_order_of_words_counts(spark, monkeypatch, head, most_bits):
    """Held-out texts score higher than their words in another order; also without a head and a filter of pairs."""
    import corpusbundle.llm.language_model as model

    monkeypatch.setattr(model, "HEAD_PAIRS", head)
    monkeypatch.setattr(model, "MOST_BITS", most_bits)
    rng = np.random.default_rng(8)
    line = [passage(k, 12).split() for k in range(6)]
    texts = [" ".join(w for k in rng.integers(0, 6, 8) for w in line[k]) for _ in range(60)]
    held = texts[:5]
    mixed = [" ".join(rng.permutation(t.split())) for t in held]
    rows = [(i, t) for i, t in enumerate(texts[5:] + held + mixed)]
    got = {r.doc_id: r for r in model.score_texts(documents(spark, rows), F.col("doc_id") < 55).collect()}
    for k in range(5):
        own, other = got[55 + k], got[60 + k]
        assert own.score > other.score + 30 and own.base_score == pytest.approx(other.base_score)
    if head > 2:
        test_order_of_words_counts.scores = {i: r.score for i, r in got.items()}
    else:
        for i, r in got.items():
            assert r.score == pytest.approx(test_order_of_words_counts.scores[i], rel=1e-6)


def test_token_probabilities_sum_to_one():
    """Over all tokens of one byte, and all longer ones by the bytes they begin with."""
    known = [b"ab", b"abc", b"b", b"", b"ca"] * 3
    table = np.zeros(2 * TOTAL)
    count_bits(known, np.ones(len(known)), table)
    table = table.astype(np.float32)
    mixer = Mixer.fresh()
    learn(mixer, table, known, np.ones(len(known)))
    # The closing byte of a word is a space, so bytes other than a space begin or go on with a word.
    one = {b: 10 ** log10_probabilities(mixer, table, [bytes([b])])[0] for b in range(256) if b != 0x20}
    assert sum(one.values()) < 1
    more = log10_probabilities(mixer, table, [b"ab", b"zq"])
    assert more[0] > more[1]


def test_predictors_travel_packed(spark, monkeypatch):
    """Tables of 46 MB of slots, most of them empty here, are neither sent nor held by the driver as such."""
    import pickle

    import corpusbundle.llm.language_model as model

    sent = []
    broadcast = type(spark.sparkContext).broadcast
    monkeypatch.setattr(
        type(spark.sparkContext), "broadcast", lambda self, x: sent.append((x, len(pickle.dumps(x)))) or broadcast(self, x)
    )
    rows = [(1, "some words and some more"), (2, None), (3, "other words")]
    got = score_texts(documents(spark, rows), F.col("doc_id") < 3).collect()
    assert len(got) == 3 and all(r.score < 0 for r in got)
    assert sent and max(size for _, size in sent) < 4 << 20
    tables = next(x for x, _ in sent if isinstance(x, model.Tables))
    assert "counts" not in vars(tables)
    want = np.zeros(2 * TOTAL)
    count_bits([b"some", b"words", b"and", b"more", b""], np.array([2, 1, 1, 1, 2]), want)
    assert np.array_equal(tables.counts, want.astype(np.float32))


def test_no_training_rows_and_no_rows(spark):
    got = score_texts(documents(spark, ODD[:5]), F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)}
    assert score_texts(documents(spark, []), F.lit(True)).count() == 0


def brute_features(text):
    from corpusbundle.llm.quality import BITS  # noqa: F401

    column = pa.array([text.encode()], pa.binary())
    (run,) = runs(column)
    slots, at = features(run)
    return slots[at[0] : at[1]]


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = ["One two!! 3", "", "a a a a a", "ÄÖ ß\nx", "One two!! 3"]
    (run,) = runs(pa.array([t.encode() for t in texts], pa.binary()))
    slots, at = features(run)
    for k, text in enumerate(texts):
        own = brute_features(text) if text else np.zeros(0, np.int64)
        assert slots[at[k] : at[k + 1]].tolist() == own.tolist()


def plain_features(text):
    """The n-grams as they are written, by kind."""
    data = text.encode()
    word = re.findall(rb"[0-9A-Za-z\x80-\xff]+", lower(text).encode())
    again = [k > 0 and word[k] == word[k - 1] for k in range(len(word))]
    kinds = [(rb"[0-9]", b"0"), (rb"[A-Z]", b"A"), (rb"[a-z\x80-\xff]", b"a")]
    shape = []
    for w in re.findall(rb"[^\x20\x09-\x0D]+", data):
        for pattern, sign in kinds:
            w = re.sub(pattern, sign, w)
        shape.append(re.sub(rb"(.)\1+", rb"\1", w, flags=re.S))
    found = set()
    for kind, items, widths in (("again", again, [4]), ("word", word, [1, 2]), ("shape", shape, [1, 2, 3])):
        for n in widths:
            found |= {(kind, n, *items[k : k + n]) for k in range(len(items) - n + 1)}
    return found


def test_features_are_the_distinct_grams():
    texts = ["One two!! 3", "", "a a a a a a b", "Ab12 cd-34, AB99 ef--7 x", "so so so so good", "One two 33 \n three"]
    texts += [passage(4, 60), passage(4, 30) + " One two"]
    (run,) = runs(pa.array([t.encode() for t in texts], pa.binary()))
    slots, at = features(run)
    hashed = [set(slots[a:b].tolist()) for a, b in zip(at, at[1:])]
    plain = [plain_features(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i + 1):
            assert len(hashed[i] & hashed[j]) == len(plain[i] & plain[j]), (i, j)


def test_descent_reaches_the_least_hinge_loss():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 12, 5)) for _ in range(60)]
    values = [rng.normal(size=len(r)) for r in rows]
    y = np.where(rng.random(60) < 0.4, 1, -1)
    cost = rng.uniform(0.2, 1.5, 60)
    x = np.zeros((60, 13))
    for i, (r, v) in enumerate(zip(rows, values)):
        x[i, r] = v
    x[:, 12] = 1

    def loss(w):
        return 0.5 * w @ w + cost @ np.maximum(1 - y * (x @ w), 0)

    full, bias = _descend(rows, values, y, cost, 5000)
    got = np.append(full[:12], bias)
    assert not full[12:].any()
    # Plain subgradient steps over all rows, and steps around the result, find nothing lower
    # beyond what the descent's last steps (under 1e-4 each) leave.
    w, best = np.zeros(13), np.inf
    for k in range(1, 20_001):
        inside = (y * (x @ w) < 1) * cost * y
        w = w - (w - x.T @ inside) / k
        best = min(best, loss(w))
    assert loss(got) <= best * 1.0001 and best <= loss(got) * 1.01
    assert all(loss(got + rng.normal(size=13) * s) >= loss(got) * 0.9999 for s in (1e-1, 1e-2, 1e-3) for _ in range(50))


def test_fit_and_scores_by_brute_force():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["good", "fine", "plain", "bad", "odd", "worse"], 8, p=p)) for p in
             ([0.3, 0.3, 0.2, 0.1, 0.05, 0.05], [0.05, 0.05, 0.2, 0.1, 0.3, 0.3]) * 40]
    labels = np.array([1, 0] * 40)
    (run,) = runs(pa.array([t.encode() for t in texts], pa.binary()))
    slots, at = features(run)
    rows = [slots[a:b] for a, b in zip(at, at[1:])]
    model = fit(rows, labels)
    use = [i for i in range(80) if i % 5]
    n = {c: sum(labels[i] == c for i in use) for c in (0, 1)}
    met = {c: Counter(f for i in use if labels[i] == c for f in rows[i].tolist()) for c in (0, 1)}
    ratio = {
        f: math.log((met[1][f] + 1) / (n[1] + 2)) - math.log((met[0][f] + 1) / (n[0] + 2)) for f in set(slots.tolist())
    }
    values = [np.array([ratio[f] for f in rows[i].tolist()]) / math.sqrt(len(rows[i])) for i in use]
    y = np.where(labels[use] > 0, 1, -1)
    cost = np.array([0.5 * len(use) / n[int(labels[i])] for i in use])
    w, bias = _descend([rows[i] for i in use], values, y, cost, 20)
    margin = [sum(w[f] * ratio[f] for f in r.tolist()) / math.sqrt(len(r)) + bias for r in rows]
    scores = model.scores(pa.array([t.encode() for t in texts], pa.binary()))
    plain = [1 / (1 + math.exp(-(model.slope * m + model.offset))) for m in margin]
    np.testing.assert_allclose(scores, plain, rtol=1e-3)
    # The scale comes from the rows left out of the fit: their scores sum to about their labels.
    held = [i for i in range(80) if i % 5 == 0]
    assert sum(plain[i] for i in held) == pytest.approx(labels[held].sum(), abs=1)
    assert model.slope > 0 and ((scores > 0.5) == labels).mean() > 0.9


def test_a_document_with_two_texts_gives_one_model(spark):
    rows = [(k, ("good " if k % 2 else "bad ") * 5 + f"x{k}") for k in range(40)]
    twice = rows + [(k, t.upper() + " other text") for k, t in rows]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, quality int")
    first = train(documents(spark, twice), labels)
    again = train(documents(spark, twice[::-1]).repartition(5), labels)
    assert (first.weight == again.weight).all() and (first.bias, first.slope) == (again.bias, again.slope)


def test_fit_separates_classes_and_is_steady():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 12) + (60 if k % 3 else 0)) for k in range(300)]
    labels = np.array([k % 3 > 0 for k in range(300)], dtype=int)
    model, again = fit(rows, labels), fit(rows, labels)
    margin = np.array([model.weight[r].sum() / np.sqrt(len(r)) for r in rows]) + model.bias
    score = 1 / (1 + np.exp(-(model.slope * margin + model.offset)))
    assert ((score > 0.5) == labels).mean() > 0.99
    assert (model.weight == again.weight).all() and model.slope == again.slope


def test_one_class_or_none_gives_a_constant(spark):
    docs = documents(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, quality int, text string")
    one = spark.createDataFrame([(1, 1, "x"), (9, 1, "x"), (None, 0, "x"), (4, None, "x")], none.schema)
    for labels, expected in ((none, 0.5), (one, 0.75)):
        scores = {r.s for r in with_scores(docs, train(docs, labels), name="s").collect()}
        assert [round(s, 6) for s in scores] == [expected]
    assert with_scores(documents(spark, []), train(docs, none), name="s").count() == 0


def test_quality_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op8_quality"](spark, sf)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = {r.doc_id: r for r in got.collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(r.quality, rows[r.doc_id].predicted) for r in labels if rows[r.doc_id].held_out]
    good = [p for q, p in held if q == 1]
    bad = [p for q, p in held if q == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_folds(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(50), None]], "doc_id long")
    got = {r.doc_id: r.f for r in rows.select("doc_id", in_fold("doc_id", 5, 0).alias("f")).collect()}
    text = lambda i: "" if i is None else str(i)
    assert got == {i: zlib.crc32(text(i).encode()) % 5 == 0 for i in got}
