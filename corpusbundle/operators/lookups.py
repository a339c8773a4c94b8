"""Joins between a large table and a rule table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbundle.functions.urls import path_allowed, url_host, url_path
from corpusbundle.operators.dedupe import keep_last_wide
from corpusbundle.operators.durable import durable, durable_table
from corpusbundle.operators.ordering import with_positions

BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 16


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Measure a table with one aggregate job."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).first()[0]
    return (size or 0) <= limit


def lookup_join(
    big: DataFrame,
    rules: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    broadcast_bytes: int = BROADCAST_BYTES,
    salts: int = SALTS,
    written: bool = False,
) -> DataFrame:
    """Join every row of ``big`` with its rules.

    The rules are checkpointed, so that what is measured is what is joined, unless they are
    read from a table that was ``written`` for it. Rules
    below ``broadcast_bytes`` are broadcast and ``big`` is not shuffled. Larger
    rule tables are hash-joined on (on, salt): the rows of one hot key spread
    over ``salts`` tasks by a hash of ``spread_by``, and each (narrow) rule row
    is repeated once per salt.
    """
    rules = rules if written else durable(rules)
    if fits_broadcast(rules, broadcast_bytes):
        return big.join(F.broadcast(rules), list(on), how)
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return (
        big.withColumn("_salt", salt)
        .join(rules.withColumn("_salt", copies).hint("shuffle_hash"), [*on, "_salt"], how)
        .drop("_salt")
    )


def pages_of_sites(pages: DataFrame, sites: DataFrame, **options) -> DataFrame:
    """Every page with every site on its host; keeps all page columns and the site row.

    Columns besides ``html`` should tell copies of a page apart. Adds
    ``url_host``, ``url_path``, ``site`` (struct) and ``allowed``.
    """
    located = pages.withColumns(
        {"url_host": url_host(F.col("url")), "url_path": url_path(F.col("url"))}
    )
    rules = sites.select(url_host(F.col("base_url")).alias("url_host"), F.struct("*").alias("site"))
    spread_by = [c for c in pages.columns if c != "html"]
    joined = lookup_join(located, rules, ["url_host"], spread_by, **options)
    allowed = path_allowed(
        F.col("url_path"), F.col("site.allowed_paths"), F.col("site.exclude_paths")
    )
    return joined.withColumn("allowed", allowed)


class SiteIndex(NamedTuple):
    """Site rules by number, and what URLs meet. Both are written tables.

    ``sites`` is (site_no, site): of two sites that allow a URL the one with the greater number
    has it. ``rules`` is (_host, _base, _prefix, _excluded, site_no), a row for each allowed path.
    """

    sites: DataFrame
    rules: DataFrame


def site_index(sites: DataFrame) -> SiteIndex:
    """Number the sites by base URL, then by the whole rule row; equal rows are one site."""
    each = sites.select(F.struct("*").alias("site")).select(
        "site", F.col("site.base_url").alias("_url"), F.to_json("site").alias("_json")
    )
    distinct = each.groupBy("_url", "_json").agg(F.first("site").alias("site"))
    numbered = with_positions(distinct, [], ["_url", "_json"])
    numbered = durable_table(numbered.select(F.col("ordinal").alias("site_no"), "site"))
    paths = numbered.select(
        url_host(F.col("site.base_url")).alias("_host"),
        _base_path().alias("_base"),
        F.col("site.exclude_paths").alias("_excluded"),
        "site_no",
        F.explode(F.array_distinct("site.allowed_paths")).alias("_path"),
    ).withColumn("_prefix", F.concat("_base", "_path"))
    # Of rules that differ in nothing that decides here, the one that would win is kept.
    rules = paths.groupBy("_host", "_base", "_prefix", "_excluded").agg(F.max("site_no").alias("site_no"))
    return SiteIndex(numbered, durable_table(rules.filter(F.col("_host").isNotNull() & F.col("_prefix").isNotNull())))


def _base_path() -> Column:
    return F.regexp_replace(url_path(F.col("site.base_url")), r"/\z", "")


def _prefixes(rows: DataFrame, rules: DataFrame, key: str, **options) -> DataFrame:
    """A row for each prefix of ``url_path`` with a length that the rules of the row's key have."""
    lengths = rules.groupBy(key).agg(F.collect_set(F.length("_prefix")).alias("_lengths"))
    held = lookup_join(rows, lengths, [key], ["url"], **options)
    cut = F.transform(
        "_lengths", lambda n: F.when(F.length("url_path") >= n, F.substring("url_path", F.lit(1), n))
    )
    return held.withColumn("_prefix", F.explode(F.filter(cut, lambda p: p.isNotNull()))).drop("_lengths")


def allowed_urls(urls: DataFrame, index: SiteIndex, **options) -> DataFrame:
    """(url, url_path, site_no) of the URLs that a site allows, each once.

    A site allows what lies below its base path, under one of its allowed paths taken from
    there, and under no excluded one. URLs and rules meet on (host, path prefix): a URL is
    looked up at the prefix lengths that its host's rules have, so a host with many pages
    and many rules gives no pairs of them. Only the numbers of sites travel with URLs.
    """
    located = urls.select("url", url_host(F.col("url")).alias("_host"), url_path(F.col("url")).alias("url_path"))
    keyed = _prefixes(located, index.rules, "_host", **options)
    met = lookup_join(keyed, index.rules, ["_host", "_prefix"], ["url"], written=True, **options)
    below = F.substr("url_path", F.length("_base") + F.lit(1))
    # The base path ends at a slash or at the end of the URL's path.
    whole = below.startswith("/") | (below == "")
    excluded = F.exists(F.coalesce("_excluded", F.array().cast("array<string>")), lambda x: below.startswith(x))
    return (
        met.filter(whole & ~F.coalesce(excluded, F.lit(False)))
        .groupBy("url")
        .agg(F.first("url_path").alias("url_path"), F.max("site_no").alias("site_no"))
    )


def sites_of_urls(urls: DataFrame, sites: DataFrame, **options) -> DataFrame:
    """(url, url_path, site) of the URLs that a site allows, each once (see ``allowed_urls``)."""
    index = site_index(sites)
    return allowed_urls(urls, index, **options).join(index.sites, "site_no").select("url", "url_path", "site")


def first_by_prefix(rows: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """(url, url_path, site_no, value): of the site's rules whose prefix begins the path, the first one's value.

    ``rows`` has (url, url_path, site_no) with each URL once, ``rules`` (site_no, _prefix, _position,
    value). Rows meet the rules at the prefix lengths that their site has, whatever the number
    of rules; of one prefix only the first rule is looked up. Rows that no rule meets are left out.
    """
    first = durable_table(
        rules.groupBy("site_no", "_prefix").agg(F.min(F.struct("_position", "value")).alias("_rule"))
    )
    keyed = _prefixes(rows, first, "site_no", **options)
    met = lookup_join(keyed, first, ["site_no", "_prefix"], ["url"], written=True, **options)
    return (
        met.groupBy("url", "url_path", "site_no")
        .agg(F.min("_rule").alias("_rule"))
        .select("url", "url_path", "site_no", "_rule.value")
    )


def override_rules(index: SiteIndex) -> DataFrame:
    """Rules for ``first_by_prefix`` whose value is the (css, excludes) in force below a path.

    A site's own selectors stand after all overrides, at the empty prefix; an override
    without a selector takes the site's, its excludes replace the site's even when empty.
    """
    none = F.array().cast("array<string>")
    site = F.col("site")

    def value(css: Column, excludes: Column) -> Column:
        return F.struct(
            F.coalesce(css, site["css_locator"], F.lit("")).alias("css"), F.coalesce(excludes, none).alias("excludes")
        ).alias("value")

    own = index.sites.select(
        "site_no", F.lit("").alias("_prefix"), F.lit((1 << 31) - 1).alias("_position"),
        value(F.lit(None).cast("string"), site["exclude_selectors"]),
    )
    each = index.sites.select("site_no", "site", F.posexplode("site.path_overrides").alias("_position", "_o"))
    overrides = each.filter("_o.path is not null").select(
        "site_no", F.col("_o.path").alias("_prefix"), "_position",
        value(F.nullif("_o.css_locator", F.lit("")), F.col("_o.exclude_selectors")),
    )
    return own.unionByName(overrides)


def path_rules(index: SiteIndex) -> DataFrame:
    """Rules for ``first_by_prefix`` whose value is the allowed path that a URL belongs to."""
    each = index.sites.select("site_no", _base_path().alias("_base"), F.posexplode("site.allowed_paths").alias("_position", "value"))
    return each.filter("value is not null and _base is not null").select(
        "site_no", F.concat("_base", "value").alias("_prefix"), "_position", "value"
    )


def pages_of_seeds(
    pages: DataFrame,
    seeds: DataFrame,
    arrival: Sequence[str],
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """The latest page of every seed that has one; ``seeds`` holds each URL once.

    Pages are selected before copies are settled, so copies of other pages never move.
    Few seeds are broadcast; many are joined by hash, and a URL with many copies is
    split like any large partition of a join.
    """
    seeds = durable(seeds)
    few = fits_broadcast(seeds, broadcast_bytes)
    found = pages.join(F.broadcast(seeds) if few else seeds, "url")
    return keep_last_wide(found, ["url"], arrival)


def seeds_without_page(seeds: DataFrame, pages: DataFrame) -> DataFrame:
    """Seeds that no page answers; copies of a URL are merged before the shuffle."""
    return seeds.join(pages.select("url").distinct(), "url", "left_anti")
