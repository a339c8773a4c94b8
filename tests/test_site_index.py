"""Site rules met by number and prefix: large lists, shared hosts, and pages that arrive in batches."""

import random

import pytest
from pyspark.sql import functions as F

from corpusbundle.operators.lookups import allowed_urls, first_by_prefix, override_rules, path_rules, site_index
from corpusbundle.plans.web import hosted_pages, hosted_paths, hosted_rules, site_path, with_rules
from corpusbundle.sources.sites import sites_table
from corpusbundle.streaming.pages import write_converted

PAGE = "page_id long, url string, html string"


def some_sites(seed):
    """Sites that share hosts, lie below one another, and repeat."""
    r = random.Random(seed)
    rules = []
    for i in range(30):
        base = f"https://h{r.randint(0, 4)}.org" + r.choice(["", "/", "/a", "/a/b", "/a/"])
        overrides = [
            {"path": r.choice(["/a", "/a/b", "/a/b/1", "/c", ""]), "css_locator": r.choice(["", "p", None]),
             "exclude_selectors": r.choice([None, [], [f".x{i}"]])}
            for _ in range(r.randint(0, 4))
        ]
        rules.append({
            "base_url": base,
            "css_locator": r.choice([None, "", "main"]),
            "exclude_selectors": r.choice([None, [".ad"]]),
            "allowed_paths": r.choice([[], [""], ["/b", "/b/1"], ["/b/1", "/b"], ["/", "/c"]]),
            "exclude_paths": r.choice([None, [], ["/b/2"], ["/c/d"]]),
            "path_overrides": r.choice([None, overrides]),
        })
    return rules + rules[:3] + [{"base_url": None, "allowed_paths": [""]}, {"base_url": "https://h1.org"}]


def some_pages(seed):
    r = random.Random(seed)
    paths = ["", "/", "/a", "/a/b", "/a/b/1", "/a/b/2/x", "/b/1", "/b", "/c/d", "/c", "/ab", "/a/c?q=1"]
    rows = [(i, f"https://h{r.randint(0, 5)}.org{r.choice(paths)}", f"<title>t{i}</title>") for i in range(150)]
    return rows + [(900, None, "<title>x</title>"), (901, "::", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_look_ups_equal_the_arrays_of_each_row(spark, seed):
    sites, pages = sites_table(spark, some_sites(seed)), spark.createDataFrame(some_pages(seed), PAGE)
    found = hosted_pages(pages, sites, ["page_id"], columns=())
    rules = {r.url: (r.css, r.excludes) for r in hosted_rules(pages, sites).collect()}
    assert rules == {r.url: (r.css, r.excludes) for r in with_rules(found).collect()} and len(rules) > 10
    paths = {r.url: r.matched_path for r in hosted_paths(pages, sites).collect()}
    want = found.select("url", site_path(F.col("url_path")).alias("p")).collect()
    assert paths == {r.url: r.p for r in want}


def test_joined_by_hash_or_broadcast(spark):
    sites, pages = sites_table(spark, some_sites(3)), spark.createDataFrame(some_pages(3), PAGE)
    index = site_index(sites)
    urls = pages.select("url").distinct()
    results = []
    for options in ({}, {"broadcast_bytes": 0, "salts": 3}):
        allowed = allowed_urls(urls, index, **options)
        first = first_by_prefix(allowed, path_rules(index), **options)
        results.append(sorted((r.url, r.site_no, r.value) for r in first.collect()))
    assert results[0] == results[1] and results[0]


def test_very_many_overrides_of_one_site(spark):
    """100,000 overrides, met by prefix; a sample is compared with the first override that fits."""
    n = 100_000
    overrides = [{"path": f"/p/{(i * 7919) % 60_000}", "css_locator": f"c{i}", "exclude_selectors": None} for i in range(n)]
    site = {"base_url": "https://a.org", "css_locator": "own", "allowed_paths": ["/"], "path_overrides": overrides}
    urls = [f"https://a.org/p/{i}" for i in range(0, 120_000, 997)] + ["https://a.org/q"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], PAGE)
    found = {r.url: r.css for r in hosted_rules(pages, sites_table(spark, [site])).collect()}
    for url in urls:
        path = url.removeprefix("https://a.org")
        assert found[url] == next((o["css_locator"] for o in overrides if path.startswith(o["path"])), "own")


def test_no_rule_row_is_shuffled_with_urls(spark):
    sites, pages = sites_table(spark, some_sites(1)), spark.createDataFrame(some_pages(1), PAGE)
    index = site_index(sites)
    allowed = allowed_urls(pages.select("url").distinct(), index)
    for found in (allowed, first_by_prefix(allowed, override_rules(index))):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "path_overrides" not in plan and "file_name_prefix" not in plan


def test_a_stream_finds_what_the_batch_finds(spark, tmp_path):
    rules, rows = some_sites(4), [r for r in some_pages(4) if r[1]]
    sites = sites_table(spark, rules)
    arriving, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:70], rows[70:]):
        spark.createDataFrame(part, PAGE).write.mode("append").parquet(arriving)
        pages = spark.readStream.schema(PAGE).parquet(arriving)
        write_converted(pages, sites, out, str(tmp_path / "cp"), available_now=True).awaitTermination(240)
    written = spark.read.parquet(out)
    every = {(r.page_id, r.url, r.base_url) for r in written.collect()}
    assert written.count() == len(every)
    latest = {u: (b, i) for i, u, b in sorted(every, key=lambda r: r[0])}
    batch = hosted_pages(spark.createDataFrame(rows, PAGE), sites, ["page_id"])
    page = {html: i for i, _, html in rows}
    assert latest == {r.url: (r.site.base_url, page[r.html]) for r in batch.collect()} and latest
