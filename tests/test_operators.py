import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from corpusbundle.operators.bundles import bundle_parts
from corpusbundle.operators.dedupe import keep_last
from corpusbundle.operators.lookups import lookup_join, pages_of_seeds, pages_of_sites, seeds_without_page
from corpusbundle.operators.ordering import with_positions
from corpusbundle.operators.profiles import ext_profile, run_summary
from corpusbundle.operators.rules import rule_violations, selector_violations
from corpusbundle.operators.schedule import throttle_schedule
from corpusbundle.plans.profile import generated_policy
from corpusbundle.schemas import POLICY_SCHEMA
from corpusbundle.sources.sites import seed_urls, sites_from_urls, sites_table


def skewed(rng, n):
    """Half of the rows belong to one key; some keys are null."""
    keys = ["hot"] * (n // 2) + [rng.choice(["a", "b", "c", None]) for _ in range(n - n // 2)]
    rng.shuffle(keys)
    return keys


def test_positions_of_a_hot_key_are_spread_and_exact(spark):
    rng = random.Random(1)
    rows = [(k, f"p{i:05d}", rng.randint(0, 9)) for i, k in enumerate(skewed(rng, 2000))]
    df = spark.createDataFrame(rows, "k string, o string, n long").repartition(5)
    placed = with_positions(df, ["k"], ["o"], "n", slices=7).collect()
    expected, seen = {}, {}
    for k, o, n in sorted(rows, key=lambda r: r[1]):
        at, offset = seen.get(k, (0, 0))
        expected[o] = (k, at, offset)
        seen[k] = (at + 1, offset + n)
    assert {r.o: (r.k, r.ordinal, r.byte_offset) for r in placed} == expected


def test_positions_without_a_key(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("o"))
    placed = with_positions(df, [], ["o"], slices=6).collect()
    assert sorted((r.o, r.ordinal) for r in placed) == [(i, i) for i in range(1000)]


def test_rows_that_share_a_place_fail_the_job(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 2, "c")], "k string, o int, t string")
    with pytest.raises(Exception, match="share their place"):
        bundle_parts(df, ["k"], ["o"], "t").collect()


@pytest.mark.parametrize("sep", ["", "\n\n"])
@pytest.mark.parametrize("part_bytes", [1, 50, 10**9])
def test_parts_make_the_document(spark, sep, part_bytes):
    rng = random.Random(3)
    rows = [
        (k, i, rng.choice(["", " ", "é" * rng.randint(1, 9), "text\n"])) for i, k in enumerate(skewed(rng, 300))
    ]
    df = spark.createDataFrame(rows, "k string, o int, t string")
    parts = bundle_parts(df, ["k"], ["o"], "t", sep, part_bytes).collect()
    for key in {k for k, _, _ in rows}:
        whole = sep.join(t for k, _, t in rows if k == key).encode()
        mine = sorted((p for p in parts if p.k == key), key=lambda p: p.part_no)
        assert "".join(p.text for p in mine).encode() == whole
        at = 0
        for p in mine:
            assert p.byte_offset == at or p.text == ""
            at = p.byte_offset + len(p.text.encode())
        assert sum(p.n_sections for p in mine) == sum(k == key for k, _, _ in rows)
        if part_bytes > len(whole):
            assert len(mine) == 1


def test_blank_documents_can_be_skipped(spark):
    rows = [("x", 1, " "), ("x", 2, "\n"), ("y", 1, ""), ("y", 2, "z"), (None, 1, "\t"), ("x", 0, " ")]
    df = spark.createDataFrame(rows, "k string, o int, t string")
    kept = bundle_parts(df, ["k"], ["o"], "t", "-", skip_blank=True).collect()
    assert [(r.k, r.text) for r in kept] == [("y", "-z")]


def simulate(requests, interval, burst):
    """A bucket that holds tokens as times at which they become free."""
    free, out = {}, {}
    for key, arrival, ident in sorted(requests, key=lambda r: (r[1], r[2])):
        tokens = free.setdefault(key, [-(10**15)] * burst)
        # A token comes back one interval after the one before it was refilled.
        at = max(arrival, tokens[0])
        refilled = max(at, tokens[-1]) if tokens[-1] > at else at
        tokens.pop(0)
        tokens.append(refilled + interval)
        out[ident] = at
    return out


@pytest.mark.parametrize("burst", [1, 2, 5])
@pytest.mark.parametrize("keyed", [True, False])
def test_throttle_matches_a_simulation(spark, burst, keyed):
    rng = random.Random(burst)
    arrivals = [rng.choice([0, 5, rng.randint(0, 4000), rng.randint(0, 400) * 10]) * 1000 for _ in range(600)]
    rows = [(k or "n", a, i) for i, (k, a) in enumerate(zip(skewed(rng, 600), arrivals))]
    df = spark.createDataFrame(rows, "k string, a long, i int")
    found = throttle_schedule(df, "k" if keyed else None, "a", "i", rate=100.0, burst=burst, slices=5)
    expected = simulate([(k if keyed else 0, a, i) for k, a, i in rows], 10_000, burst)
    got = {r.i: r.admit_us for r in found.collect()}
    assert got == expected
    assert all(r.wait_us == r.admit_us - r.a for r in found.collect())


def test_throttle_refuses_bad_rates(spark):
    df = spark.createDataFrame([("k", 0, 0)], "k string, a long, i int")
    for rate, burst in ((0, 1), (-1.0, 1), (1.0, 0)):
        with pytest.raises(ValueError):
            throttle_schedule(df, "k", "a", "i", rate, burst)


def test_keep_last(spark):
    rows = [("u", 1, 1, "old"), ("u", 2, 1, "new"), ("u", 2, 0, "tie"), ("v", 0, 0, None), (None, 1, 1, "n")]
    df = spark.createDataFrame(rows, "k string, at int, tie int, x string")
    kept = keep_last(df, ["k"], ["at", "tie"])
    assert kept.columns == df.columns
    assert {(r.k, r.x) for r in kept.collect()} == {("u", "new"), ("v", None), (None, "n")}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_lookup_equals_broadcast(spark, how):
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(300)], "k string, i int")
    rules = spark.createDataFrame([("hot", "a"), ("hot", "b"), ("k0", "c"), ("none", "d")], "k string, r string")
    both = [
        sorted(map(str, lookup_join(big, rules, ["k"], ["i"], how, broadcast_bytes=limit).collect()))
        for limit in (10**9, 0)
    ]
    assert both[0] == both[1]
    assert len(both[0]) == 401 if how == "inner" else len(both[0]) == 500
    salted = lookup_join(big, rules, ["k"], ["i"], how, broadcast_bytes=0)
    assert "_salt" in salted._jdf.queryExecution().toString()


def test_latest_pages_of_few_and_many_seeds(spark):
    rows = [("hot", i, f"h{i}") for i in range(200)] + [("a", 1, "x"), ("b", 1, "no seed")]
    pages = spark.createDataFrame(rows, "url string, at int, html string")
    seeds = spark.createDataFrame([("hot", "s"), ("a", "t"), ("none", "u")], "url string, site string")
    for limit in (10**9, 0):
        found = pages_of_seeds(pages, seeds, ["at"], limit)
        assert {(r.url, r.at, r.html, r.site) for r in found.collect()} == {
            ("hot", 199, "h199", "s"), ("a", 1, "x", "t")
        }


SITES = [
    {
        "base_url": "http://museum.test:81", "css_locator": "#hall", "exclude_selectors": ["nav", ".map"],
        "allowed_paths": ["/rooms", "", "/art"], "exclude_paths": ["/rooms/closed"], "file_name_prefix": "m",
        "path_overrides": [
            {"path": "/rooms/1", "css_locator": "", "exclude_selectors": [".price"]},
            {"path": "/art", "css_locator": "figure", "exclude_selectors": []},
        ],
        "pages_each_day": 7,
    },
    {"base_url": "https://lab.test", "allowed_paths": ["/runs"]},
]


def test_sites_and_seeds(spark):
    sites = sites_table(spark, SITES)
    first = sites.first()
    assert first.path_overrides[0].exclude_selectors == [".price"] and "pages_each_day" not in sites.columns
    seeds = seed_urls(sites).select("url", "path_no").collect()
    assert {tuple(s) for s in seeds} == {
        ("http://museum.test:81/rooms", 0), ("http://museum.test:81", 1), ("http://museum.test:81/art", 2),
        ("https://lab.test/runs", 0),
    }
    pages = spark.createDataFrame([("http://museum.test:81",)] * 3, "url string")
    left = {r.url for r in seeds_without_page(seed_urls(sites), pages).collect()}
    assert left == {"http://museum.test:81/rooms", "http://museum.test:81/art", "https://lab.test/runs"}
    plain = sites_from_urls(pages.distinct(), "h1", [".ad"])
    assert plain.schema.fieldNames() == sites.schema.fieldNames()
    assert [s.url for s in seed_urls(plain).collect()] == ["http://museum.test:81"]


def test_pages_of_sites(spark):
    urls = [
        "http://museum.test:81/rooms/2", "http://museum.test:81/rooms/closed",
        "https://lab.test:9/runs", "https://lab.test/runs/a",
    ]
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    for limit in (10**9, 0):
        found = pages_of_sites(pages, sites_table(spark, SITES), broadcast_bytes=limit)
        assert {(r.url, r.allowed) for r in found.collect()} == {
            (urls[0], True), (urls[1], False), (urls[3], True)
        }


def test_rule_violations(spark):
    named, unnamed = [{"base_url": "ftp://lab.test"}], [{"base_url": "x"}, {"base_url": ""}]
    cases = [
        ({"file_extensions": ["rs", "c"], "requests_per_second": 0.5, "burst_limit": 9}, []),
        ({"sites": named, "output_type": "separate", "burst_limit": 1}, []),
        ({"sites": named, "file_extensions": [], "output_type": ""}, []),
        ({"file_extensions": [], "sites": []}, [1]),
        ({"sites": named, "output_type": "Single"}, [2]),
        ({"sites": named, "requests_per_second": 0.0, "burst_limit": 2}, [3]),
        ({"file_extensions": ["c"], "burst_limit": 0}, [4]),
        ({"sites": unnamed, "requests_per_second": -0.1}, [3, 5]),
        ({"output_type": "x", "requests_per_second": -3.0, "burst_limit": -2}, [1, 2, 3, 4]),
    ]
    names = POLICY_SCHEMA.fieldNames()

    def row(policy):
        sites = policy.get("sites")
        full = {**policy}
        if sites is not None:
            full["sites"] = [{"base_url": s.get("base_url")} for s in sites]
        return {n: full.get(n) for n in names}

    df = spark.createDataFrame([row(p) for p, _ in cases], POLICY_SCHEMA).withColumn(
        "id", F.monotonically_increasing_id()
    )
    order = {r.id: i for i, r in enumerate(df.orderBy("id").collect())}
    found = {}
    for r in rule_violations(df, "id").orderBy("id", "check_no").collect():
        found.setdefault(order[r.id], []).append(r.check_no)
        assert r.is_first == (len(found[order[r.id]]) == 1)
    assert [found.get(i, []) for i in range(len(cases))] == [v for _, v in cases]


def test_selector_violations(spark):
    rules = [
        {
            "base_url": "u", "css_locator": "p:nth-child(2)", "exclude_selectors": [".a", "a[href='x:y']", "a[b~=c] + d"],
            "path_overrides": [{"path": "/", "css_locator": "b:not(.x)", "exclude_selectors": ["i:hover", "i"]}],
        },
        {"base_url": "v"},
    ]
    found = {(r.base_url, r.selector) for r in selector_violations(sites_table(spark, rules)).collect()}
    assert found == {("u", "p:nth-child(2)"), ("u", "b:not(.x)"), ("u", "i:hover"), ("u", "a[b~=c] + d")}


def test_profiles(spark):
    rows = [("a.go", 3), ("b/c.go", 4), ("d.md", 0), ("e.exe", 9), (".bash", 1), ("Makefile", 1)]
    listing = spark.createDataFrame(rows, "rel_path string, size long")
    assert [tuple(r) for r in ext_profile(listing).collect()] == [("bash", 1, 1), ("go", 2, 7), ("md", 1, 0)]
    policy = generated_policy(listing).first()
    assert policy.file_extensions == ["bash", "go", "md"]
    assert policy.ignore_paths == ["node_modules/**", "vendor/**", ".git/**"]


def test_run_summary(spark):
    rows = [("s", "u", "é"), ("s", "u", "x"), ("s", "v", None), ("t", "w", "")]
    df = spark.createDataFrame(rows, "site string, url string, content string")
    found = {tuple(r) for r in run_summary(df, "site").collect()}
    assert found == {("s", 2, 1, 3), ("t", 1, 1, 0)}


@pytest.mark.parametrize("rate", [3_000_000, 400_000, 3, Fraction(7, 3), 0.1])
def test_throttle_keeps_intervals_that_are_no_whole_microseconds(spark, rate):
    """Against exact fractions, one request after the other."""
    arrivals = [0] * 12 + [4, 5, 9, 1_000_000, 1_000_001] + [2_000_000] * 5
    df = spark.createDataFrame(list(enumerate(arrivals)), "i long, at long")
    found = {r.i: r.admit_us for r in throttle_schedule(df, None, "at", "i", rate, 2, slices=3).collect()}
    step, tokens, last = 1_000_000 / Fraction(rate).limit_denominator(1_000_000), Fraction(2), Fraction(0)
    for i, at in enumerate(arrivals):
        now = max(Fraction(at), last)
        tokens = min(Fraction(2), tokens + (now - last) / step)
        wait = max(Fraction(0), (1 - tokens) * step)
        last, tokens = now + wait, max(tokens - 1, Fraction(0))
        assert found[i] == math.ceil(last), i
