"""Stored pages and site rules to bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusbundle.functions.names import group_file_name
from corpusbundle.functions.text import non_blank, page_section
from corpusbundle.functions.urls import matched_path, resolve_override, url_path
from corpusbundle.operators.bundles import PART_BYTES, bundle_parts
from corpusbundle.operators.durable import durable_table
from corpusbundle.operators.lookups import (
    allowed_urls,
    first_by_prefix,
    lookup_join,
    override_rules,
    pages_of_seeds,
    path_rules,
    site_index,
)
from corpusbundle.operators.pages import page_content
from corpusbundle.operators.rules import OUTPUT_TYPES
from corpusbundle.sources.sites import seed_urls


# Fixed value: the document of all pages.
COMBINED_NAME = "combined.md"

GROUP = ("base_url", "prefix", "matched_path")


def distinct_seeds(sites: DataFrame) -> DataFrame:
    """Every seed URL once; among several sites that ask for it the last base URL has it."""
    # Rules that share a base URL differ somewhere else, so the whole row settles ties.
    last = F.max_by("site", F.struct("site.base_url", "path_no", F.to_json("site"))).alias("site")
    return seed_urls(sites).groupBy("url").agg(last)


def seeded_pages(
    pages: DataFrame, sites: DataFrame, arrival: Sequence[str], columns: Sequence[str] = ("html",)
) -> DataFrame:
    """Latest page of every seed URL with its site (columns url, ``columns``, url_path, site)."""
    found = pages_of_seeds(pages.select("url", *columns, *arrival), distinct_seeds(sites), arrival)
    return found.select("url", *columns, url_path(F.col("url")).alias("url_path"), "site")


def seed_results(
    pages: DataFrame, sites: DataFrame, arrival: Sequence[str], columns: Sequence[str] = ("html",)
) -> DataFrame:
    """Every seed URL once, with its latest page or nulls (columns as ``seeded_pages``)."""
    answered = seeded_pages(pages, sites, arrival, columns).select("url", *columns)
    return (
        distinct_seeds(sites)
        .join(answered, "url", "left")
        .select("url", *columns, url_path(F.col("url")).alias("url_path"), "site")
    )


def hosted_pages(
    pages: DataFrame, sites: DataFrame, arrival: Sequence[str], columns: Sequence[str] = ("html",)
) -> DataFrame:
    """Latest page of every URL that a site on its host allows (columns as ``seeded_pages``).

    Which site has a URL is settled on URLs alone, each once: among several that allow it
    the last base URL has it, then the greatest rule row. Pages are then selected by URL,
    and of those only copies are merged; no other page content moves unless the selected
    URLs are too many to broadcast.
    """
    index = site_index(sites)
    allowed = allowed_urls(pages.select("url").distinct(), index)
    found = pages_of_seeds(pages.select("url", *columns, *arrival), allowed, arrival)
    # The rules themselves join last, by number, as a table that is read where it is small.
    return found.join(index.sites, "site_no").select("url", *columns, "url_path", "site")


def hosted_rules(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """(url, css, excludes) in force for every URL that a site on its host allows, by look-ups of prefixes.

    Equals ``with_rules`` over ``hosted_pages``, however many overrides a site has.
    """
    index = site_index(sites)
    allowed = durable_table(allowed_urls(pages.select("url").distinct(), index))
    return first_by_prefix(allowed, override_rules(index)).select("url", "value.css", "value.excludes")


def hosted_paths(pages: DataFrame, sites: DataFrame) -> DataFrame:
    """(url, matched_path) of every URL that a site on its host allows: the first of its allowed paths that holds it."""
    index = site_index(sites)
    allowed = durable_table(allowed_urls(pages.select("url").distinct(), index))
    return first_by_prefix(allowed, path_rules(index)).select("url", F.col("value").alias("matched_path"))


def with_rules(pages: DataFrame) -> DataFrame:
    """Add the ``css`` and ``excludes`` in force for each page of a site."""
    css, excludes = resolve_override(
        F.col("url_path"), F.col("site.css_locator"),
        F.col("site.exclude_selectors"), F.col("site.path_overrides"),
    )
    return pages.withColumns({"css": css, "excludes": excludes})


def converted_pages(pages: DataFrame, content: Column | None = None) -> DataFrame:
    """Pages with their ``content``, an expression that may use the rules in force (css, excludes).

    html is dropped; a page without content stays as a row with an error.
    """
    return page_content(with_rules(pages), content).drop("css", "excludes")


def site_path(url_path_col: Column, strict: bool = False) -> Column:
    base = F.when(F.lit(strict), F.lit("")).otherwise(
        F.regexp_replace(url_path(F.col("site.base_url")), r"/\z", "")
    )
    return matched_path(url_path_col, F.col("site.allowed_paths"), base, strict)


def grouped_pages(converted: DataFrame, content: str, strict: bool = False) -> DataFrame:
    """(base_url, prefix, matched_path, url, content) of the pages that belong to a group."""
    return converted.select(
        F.col("site.base_url").alias("base_url"),
        F.coalesce("site.file_name_prefix", F.lit("")).alias("prefix"),
        site_path(F.col("url_path"), strict).alias("matched_path"),
        "url",
        F.col(content).alias("content"),
    ).filter(F.col("matched_path").isNotNull())


def filled_groups(grouped: DataFrame) -> DataFrame:
    """Rows of the groups that hold more than white space."""
    has_text = F.max(non_blank(F.col("content")).cast("int")).alias("_filled")
    filled = grouped.groupBy(*GROUP).agg(has_text).filter("_filled = 1").drop("_filled")
    return lookup_join(grouped, filled, GROUP, ["url"])


def bundle_single(converted: DataFrame, content: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """All pages in one document, ordered by URL; blank pages are kept."""
    sections = converted.filter(F.col(content).isNotNull()).select(
        "url", page_section(F.col("url"), F.col(content)).alias("section")
    )
    return bundle_parts(sections, [], ["url"], "section", part_bytes=part_bytes)


def bundle_by_path(
    converted: DataFrame, content: str, strict: bool = False, part_bytes: int = PART_BYTES
) -> DataFrame:
    """One document per site and matched path, pages in URL order; blank documents are left out."""
    rows = grouped_pages(converted, content, strict).filter(F.col("content").isNotNull())
    return bundle_parts(
        rows, GROUP, ["url"], "content",
        sep="\n\n", part_bytes=part_bytes, skip_blank=True,
    )


def with_file_names(
    rows: DataFrame, groups: DataFrame, spread_by: Sequence[str] = ("part_no",)
) -> DataFrame:
    """Add ``file_name``; groups that would share a name get a hash of their site and path.

    ``groups`` holds at least (base_url, prefix, matched_path) of every group;
    name clashes are looked for there, not among the rows and their text.
    ``spread_by`` tells the rows of one group apart.
    """
    name = group_file_name(F.col("prefix"), F.col("matched_path"))
    identity = F.struct(*GROUP)
    shared = (
        groups.select(*GROUP)
        .distinct()
        .groupBy(name.alias("_name"))
        .agg((F.min(identity) != F.max(identity)).alias("_shared"))
        .filter("_shared")
    )
    spread = ["base_url", "matched_path", *spread_by]
    tagged = lookup_join(rows.withColumn("_name", name), shared, ["_name"], spread, how="left")
    digest = F.substring(F.sha2(F.to_json(identity), 256), 1, 12)
    stem = F.regexp_replace("_name", r"\.md\z", "")
    unique = F.concat(stem, F.lit("-"), digest, F.lit(".md"))
    return tagged.withColumn(
        "file_name", F.when(F.col("_shared"), unique).otherwise(F.col("_name"))
    ).drop("_name", "_shared")


def bundle_pages(
    pages: DataFrame,
    sites: DataFrame,
    arrival: Sequence[str],
    mode: str = "separate",
    hosted: bool = False,
    strict: bool = False,
    part_bytes: int = PART_BYTES,
    content: Column | None = None,
) -> DataFrame:
    """Pages and rules to documents: select, take ``content`` (the title if none), then bundle.

    The contents are written to the shared folder, because bundling reads them twice.
    """
    if mode not in OUTPUT_TYPES:
        raise ValueError(f"unsupported output type: {mode}")
    chosen = (hosted_pages if hosted else seeded_pages)(pages, sites, arrival)
    converted = durable_table(converted_pages(chosen, content))
    if mode == "single":
        parts = bundle_single(converted, "content", part_bytes)
        return parts.withColumn("file_name", F.lit(COMBINED_NAME))
    parts = bundle_by_path(converted, "content", strict, part_bytes)
    return with_file_names(parts, grouped_pages(converted, "content", strict))
