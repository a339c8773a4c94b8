"""Every operator as a query over the supplied tables: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbundle.functions.globs import (
    ext_in,
    file_ext,
    glob_match,
    in_hidden_dir,
    is_generated,
    is_ignored,
    tree_key,
)
from corpusbundle.functions.names import (
    bundle_name,
    group_file_name,
    html_title,
    human_size,
    normalize_url_path,
    page_filename,
    page_filename_dashed,
    page_filename_error,
    sanitize_dashed,
    sanitize_name,
)
from corpusbundle.functions.text import (
    content_length,
    generated_note,
    non_blank,
    normalize_extract,
    page_section,
)
from corpusbundle.functions.urls import url_host, url_path
from corpusbundle.operators.bundles import bundle_parts, union_sections
from corpusbundle.operators.dedupe import keep_last, keep_last_wide
from corpusbundle.operators.durable import durable_table, shared_dir
from corpusbundle.operators.lookups import pages_of_sites, seeds_without_page
from corpusbundle.operators.ordering import with_positions
from corpusbundle.operators.pages import page_content
from corpusbundle.operators.patterns import with_pattern_matches
from corpusbundle.operators.profiles import ext_profile, run_summary
from corpusbundle.operators.rules import rule_violations, selector_violations
from corpusbundle.operators.schedule import throttle_schedule
from corpusbundle.plans.files import FilePolicy, bundle_table, file_sections
from corpusbundle.plans.profile import generated_policy
from corpusbundle.plans.web import (
    bundle_by_path,
    bundle_pages,
    bundle_single,
    converted_pages,
    grouped_pages,
    hosted_pages,
    hosted_paths,
    hosted_rules,
    seed_results,
    seeded_pages,
    with_file_names,
)
from corpusbundle.schemas import OVERRIDE
from corpusbundle.sinks.text import (
    write_combined_pages,
    write_grouped_pages,
    write_ordered,
    write_profile,
)
from corpusbundle.sources.pages import failed, scan_pages
from corpusbundle.sources.sites import seed_urls, sites_from_urls
from corpusbundle.sources.trees import read_ranges, scan_binary_tree, scan_tree, split_ranges

POLICY = FilePolicy(
    types=["md", "txt", "go"],
    ignore=["src1/**", "**/9*.txt", "src2", "src3/en", "[a-s]rc4/?n", "*.tmp"],
    generated=["*7.go", "**/de/1*.md", "src5/*.go"],
)
PART_BYTES = 64 * 1024
TWO_DAYS_RATE = 1 / 172_800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` seen as a file table, with look-alike and hidden directories."""
    number = F.col("doc_id")
    ext = F.element_at(strings("md", "txt", "go", "json"), (number % 4).cast("int") + 1)
    side = F.when(number % 5 == 0, F.lit("-x")).otherwise(F.lit(""))
    dot = F.when(number % 7 == 0, F.lit(".")).otherwise(F.lit(""))
    rel_path = F.concat(
        "source", side, F.lit("/"), dot, "lang", F.lit("/"), number.cast("string"), F.lit("."), ext
    )
    return table(spark, sf_dir, "documents").select(
        number, "source", rel_path.alias("rel_path"), F.col("text").alias("content")
    )


def with_size(files: DataFrame) -> DataFrame:
    return files.withColumn("size", content_length(F.col("content")))


def host_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One site per host of ``pages``, all under the same rules."""
    hosts = table(spark, sf_dir, "pages").select(url_host(F.col("url")).alias("host")).distinct()
    overrides = F.array(
        F.struct(F.lit("/fr/1"), F.lit(""), strings(".x")),
        F.struct(F.lit("/fr"), F.lit("h1"), strings()),
        F.struct(F.lit("/en/2"), F.lit("nav"), strings("li", ".y")),
    ).cast(f"array<{OVERRIDE.simpleString()}>")
    prefix = F.when(F.col("host").startswith("blog."), F.lit("")).otherwise(
        sanitize_dashed(F.col("host"))
    )
    return hosts.select(
        F.concat(F.lit("https://"), "host").alias("base_url"),
        F.lit("article").alias("css_locator"),
        strings(".ad").alias("exclude_selectors"),
        strings("/en", "/fr", "/en/1").alias("allowed_paths"),
        strings("/en/9").alias("exclude_paths"),
        prefix.alias("file_name_prefix"),
        overrides.alias("path_overrides"),
    )


def page_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URL mode: every page URL asked for over https."""
    secure = F.regexp_replace("url", "^http:", "https:").alias("url")
    urls = table(spark, sf_dir, "pages").select(secure).distinct()
    return seed_urls(sites_from_urls(urls, "h1", [".ad"]))


def joined(items: Column) -> Column:
    return F.concat_ws("|", items)


# --- files -----------------------------------------------------------------------


def q_ext_profile(spark, sf):
    return ext_profile(with_size(document_files(spark, sf)))


def q_generated_policy(spark, sf):
    policy = generated_policy(with_size(document_files(spark, sf)))
    return policy.select(
        joined(F.col("file_extensions")).alias("file_extensions"),
        joined(F.col("ignore_paths")).alias("ignore_paths"),
    )


def q_type_filter(spark, sf):
    files = document_files(spark, sf).filter(ext_in(F.col("rel_path"), POLICY.types))
    return files.select("rel_path", file_ext(F.col("rel_path")).alias("ext"))


def q_hidden_prune(spark, sf):
    return document_files(spark, sf).filter(~in_hidden_dir(F.col("rel_path"))).select("rel_path")


def q_glob_filter(spark, sf):
    path = F.col("rel_path")
    patterns = {
        "any_depth": "**/*.go",
        "mid_segment": "**/1*.md",
        "one_level": "src1/*/*.txt",
        "char_class": "src[0-3]/e?/*.go",
        "negated": "src1[^0-4]/**/*7.json",
    }
    return document_files(spark, sf).select(
        "rel_path", *(glob_match(path, p).alias(n) for n, p in patterns.items())
    )


def pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns for every source but one, a broken one among them."""
    source = F.col("source")
    own = {
        "glob": [F.concat(source, F.lit("/*/1*.md")), F.lit("**/*7.go")],
        "ignore": [F.concat(source, F.lit("-x/**")), F.lit("*/fr"), F.lit("[")],
        "generated": [F.lit("2*.txt"), F.concat(source, F.lit("/en/*.go"))],
    }
    rows = [F.struct(F.lit(k).alias("kind"), p.alias("pattern")) for k, ps in own.items() for p in ps]
    sources = table(spark, sf_dir, "documents").select("source").distinct().filter(source != "src3")
    return sources.select("source", F.explode(F.array(*rows)).alias("_p")).select("source", "_p.kind", "_p.pattern")


def q_glob_table(spark, sf):
    """Patterns per project from a table."""
    files = document_files(spark, sf).select("doc_id", "source", "rel_path")
    found = with_pattern_matches(files, pattern_table(spark, sf), ["source"])
    return found.select("rel_path", "glob_hit", "ignored", "generated")


def q_ignore_filter(spark, sf):
    kept = document_files(spark, sf).filter(~is_ignored(F.col("rel_path"), POLICY.ignore))
    return kept.select("rel_path")


def q_generated_tag(spark, sf):
    generated = is_generated(F.col("rel_path"), POLICY.generated)
    return document_files(spark, sf).select(
        "rel_path", generated.alias("generated"), generated_note(generated).alias("note")
    )


def q_tree_order(spark, sf):
    path = F.col("rel_path")
    paths = document_files(spark, sf).select("rel_path", "doc_id", tree_key(path).alias("k"))
    return with_positions(paths, [], ["k", "doc_id"]).select("rel_path", "ordinal")


def q_file_sections(spark, sf):
    return file_sections(document_files(spark, sf), POLICY).select("rel_path", "section")


def q_files_bundle(spark, sf):
    parts = bundle_table(
        document_files(spark, sf), POLICY, ["source"], ["doc_id"], PART_BYTES
    )
    return parts.select("source", "part_no", "n_sections", "byte_offset", "text")


def q_files_bundle_all(spark, sf):
    parts = bundle_table(document_files(spark, sf), POLICY, [], ["doc_id"], PART_BYTES)
    return parts.select("part_no", "n_sections", "byte_offset", "text")


def q_size_labels(spark, sf):
    number = F.col("doc_id")
    size = content_length(F.col("content")) * (number + 1) * (number % 97 + 1)
    return document_files(spark, sf).select(
        number, size.alias("size"), human_size(size).alias("label")
    )


def q_bundle_names(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", bundle_name(F.col("event_type"), F.col("ts")).alias("name")
    )


def q_normalize_extract(spark, sf):
    messy = F.concat(
        F.lit("  \r\n"),
        F.regexp_replace("content", r"\. ", ".\r\n\t "),
        F.lit(" \t\r"),
    )
    return document_files(spark, sf).select("doc_id", normalize_extract(messy).alias("clean"))


# --- pages -----------------------------------------------------------------------


def q_url_parts(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", url_host(url).alias("host"), url_path(url).alias("path")
    )


def q_url_allowed(spark, sf):
    found = pages_of_sites(table(spark, sf, "pages"), host_sites(spark, sf))
    return found.select("page_id", F.col("site.base_url").alias("base_url"), "allowed")


def q_seed_urls(spark, sf):
    return seed_urls(host_sites(spark, sf)).select("url", "path", "path_no")


def q_seed_urls_plain(spark, sf):
    return page_seeds(spark, sf).select(
        "url", "path", F.col("site.css_locator").alias("css"),
        joined(F.col("site.exclude_selectors")).alias("excludes"),
    )


def q_seed_coverage(spark, sf):
    return seeds_without_page(page_seeds(spark, sf), table(spark, sf, "pages")).select("url")


def q_seeded_pages(spark, sf):
    pages = table(spark, sf, "pages")
    sites = page_seeds(spark, sf).select("site.*")
    return seeded_pages(pages, sites, ["page_id"]).select(
        "url", "url_path", F.col("site.base_url").alias("base_url"), F.md5("html").alias("html_md5")
    )


def q_resolve_overrides(spark, sf):
    found = hosted_rules(table(spark, sf, "pages"), host_sites(spark, sf))
    return found.select("url", "css", joined(F.col("excludes")).alias("excludes"))


def q_matched_path(spark, sf):
    return hosted_paths(table(spark, sf, "pages"), host_sites(spark, sf))


def q_page_filename(spark, sf):
    html, url = F.col("html"), F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", page_filename(html, url).alias("file_name"),
        page_filename_error(html, url).alias("error"),
    )


def q_page_filename_from_url(spark, sf):
    """Text without a title falls back to the URL; half of the values are no URL at all."""
    pages = table(spark, sf, "pages")
    no_title = F.regexp_replace("html", "</?title>", "")
    url = F.when(F.col("url").startswith("https"), F.col("url")).otherwise(
        F.regexp_replace("url", "^http://[^/]*", "http://")
    )
    return pages.select(
        "page_id", page_filename(no_title, url).alias("file_name"),
        page_filename_error(no_title, url).alias("error"),
    )


def q_page_filename_dash(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", page_filename_dashed(F.col("html"), F.col("url")).alias("file_name")
    )


def q_html_title(spark, sf):
    title = html_title(F.col("html"))
    return table(spark, sf, "pages").select(
        "page_id", title.alias("title"), sanitize_name(title).alias("name")
    )


def q_normalize_path(spark, sf):
    path = url_path(F.col("url"))
    return table(spark, sf, "pages").select(
        "page_id", normalize_url_path(path).alias("normalized"),
        group_file_name(F.lit(""), path).alias("file_name"),
    )


def q_non_blank(spark, sf):
    """Which conversations hold any text once letters and digits are taken away."""
    left = F.regexp_replace("text", r"[^\s]", "")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", non_blank(F.col("text")).alias("has_text"), non_blank(left).alias("left_text")
    )


def q_dedupe_latest(spark, sf):
    return keep_last(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"])


def q_page_run_summary(spark, sf):
    pages = table(spark, sf, "pages").select(
        url_host(F.col("url")).alias("host"), "url", F.col("html").alias("content")
    )
    return run_summary(pages, "host")


def q_bundle_single(spark, sf):
    latest = durable_table(keep_last_wide(table(spark, sf, "pages"), ["url"], ["page_id"]))
    parts = bundle_single(latest, "html", PART_BYTES)
    return parts.select("part_no", "n_sections", "byte_offset", "text")


def q_bundle_by_path(spark, sf):
    found = durable_table(
        hosted_pages(table(spark, sf, "pages"), host_sites(spark, sf), ["page_id"])
    )
    parts = bundle_by_path(found, "html", part_bytes=PART_BYTES)
    return with_file_names(parts, grouped_pages(found, "html")).select(
        "file_name", "base_url", "matched_path", "part_no", "n_sections", "byte_offset", "text"
    )


def q_conversation_bundle(spark, sf):
    turns = table(spark, sf, "conversations").withColumn(
        "section", page_section(F.col("role"), F.col("text"))
    )
    return bundle_parts(turns, ["conv_id"], ["turn"], "section").select("conv_id", "n_sections", "text")


def q_corpus_union(spark, sf):
    files = file_sections(document_files(spark, sf), POLICY).select(
        F.lit("file").alias("kind"), F.col("rel_path").alias("name"), "section"
    )
    pages = table(spark, sf, "pages").select(
        F.lit("page").alias("kind"), F.col("url").alias("name"),
        page_section(F.col("url"), F.col("html")).alias("section"),
    )
    return union_sections(files, pages)


# --- page outcomes ---------------------------------------------------------------


def seed_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = page_seeds(spark, sf_dir).select("site.*")
    return converted_pages(seed_results(table(spark, sf_dir, "pages"), sites, ["page_id"]))


def q_failed_pages(spark, sf):
    return failed(seed_outcome(spark, sf)).select("url", "error")


def q_seed_summary(spark, sf):
    """Asked and answered seeds per host, with the bytes of their titles."""
    outcome = seed_outcome(spark, sf).select(
        url_host(F.col("url")).alias("host"), "url", "content"
    )
    return run_summary(outcome, "host")


def q_web_bundle(spark, sf):
    pages, sites = table(spark, sf, "pages"), host_sites(spark, sf)
    parts = bundle_pages(pages, sites, ["page_id"], hosted=True, part_bytes=PART_BYTES)
    return parts.select("file_name", "part_no", "n_sections", "byte_offset", "text")


# --- sources and sinks -----------------------------------------------------------


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/written/{uuid.uuid4().hex}"


def lines_of(written: DataFrame, *keys: str) -> DataFrame:
    """Each line of written text with its number of occurrences."""
    return written.groupBy(*keys, F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


def q_scan_pages(spark, sf):
    pages = scan_pages(spark, f"{sf}/pages.parquet")
    return pages.select("page_id", "url", F.md5("html").alias("html_md5"))


def q_hosted_base_path(spark, sf):
    """A site below a path of every host, with allowed and excluded paths that are taken from there."""
    pages = scan_pages(spark, f"{sf}/pages.parquet")
    sites = host_sites(spark, sf).withColumns(
        {
            "base_url": F.concat("base_url", F.lit("/en")),
            "allowed_paths": strings("/1", "/2", "/3"),
            "exclude_paths": strings("/33"),
        }
    )
    found = hosted_pages(pages, sites, ["page_id"], columns=())
    return found.select("url", F.col("site.base_url").alias("base_url"))


def q_section_sink(spark, sf):
    """Rendered files written in walk order, one folder per source, and read back."""
    path = new_folder(spark)
    sections = file_sections(document_files(spark, sf), POLICY)
    write_ordered(sections, path, ["tree_key", "doc_id"], "section", by=["source"])
    return lines_of(spark.read.schema("value string, source string").text(path), "source")


def q_combined_sink(spark, sf):
    path = new_folder(spark)
    latest = keep_last_wide(table(spark, sf, "pages"), ["url"], ["page_id"])
    write_combined_pages(page_content(latest), "content", path)
    return lines_of(spark.read.text(path))


def q_grouped_sink(spark, sf):
    path = new_folder(spark)
    pages = converted_pages(hosted_pages(table(spark, sf, "pages"), host_sites(spark, sf), ["page_id"]))
    write_grouped_pages(grouped_pages(pages, "content"), path)
    return lines_of(spark.read.schema("value string, file_name string").text(path), "file_name")


def q_profile_sink(spark, sf):
    path = new_folder(spark)
    write_profile(generated_policy(with_size(document_files(spark, sf))), path)
    back = spark.read.schema("file_extensions array<string>, ignore_paths array<string>").json(path)
    return back.select(
        joined(F.col("file_extensions")).alias("file_extensions"),
        joined(F.col("ignore_paths")).alias("ignore_paths"),
    )


def q_binary_tree(spark, sf):
    """Bytes below each folder of a written tree, by the listing of Spark's own file source."""
    path = new_folder(spark)
    write_ordered(file_sections(document_files(spark, sf), POLICY), path, ["tree_key", "doc_id"], "section", by=["source"])
    found = scan_binary_tree(spark, path)
    folder = F.regexp_extract("rel_path", r"\A([^/]*)/", 1)
    return found.groupBy(folder.alias("folder")).agg(F.sum("size").alias("n_bytes"))


def written_tree(spark: SparkSession, sf_dir: str) -> str:
    """The document files as a real tree in the shared folder, some names with a leading underscore."""
    place = urlparse(new_folder(spark))
    if place.scheme not in ("", "file"):
        raise ValueError("a tree of files needs a shared folder that is mounted")
    folder = unquote(place.path)
    name = F.regexp_extract("rel_path", r"[^/]*\z", 0)
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("_"), name)).when(F.col("doc_id") % 11 == 0, F.concat(F.lit("."), name))
    rel_path = F.concat(F.regexp_extract("rel_path", r"\A(.*/)", 1), F.coalesce(marked, name))

    def write(batches):
        made = set()
        for batch in batches:
            for rel, content in zip(batch["rel_path"], batch["content"]):
                path = os.path.join(folder, rel)
                if (place := os.path.dirname(path)) not in made:
                    os.makedirs(place, exist_ok=True)
                    made.add(place)
                # A task that is run again puts the same file in place once more.
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "w", encoding="utf-8", newline="") as f:
                    f.write(content or "")
                os.replace(part, path)
            yield pd.DataFrame({"n": [len(batch)]})

    os.makedirs(folder, exist_ok=True)
    files = document_files(spark, sf_dir).select(rel_path.alias("rel_path"), "content")
    files.mapInPandas(write, "n long").write.format("noop").mode("overwrite").save()
    return folder


def q_tree_scan(spark, sf):
    return scan_tree(spark, written_tree(spark, sf), range_entries=16).select("rel_path", "size")


def q_tree_read(spark, sf):
    """Files read in ranges of 997 bytes by different tasks, and put together again."""
    root = written_tree(spark, sf)
    ranges = split_ranges(scan_tree(spark, root), 997)
    texts = read_ranges(ranges.repartition("rel_path", "range_no"), root)
    whole = bundle_parts(texts, ["rel_path"], ["range_no"], "content")
    return whole.select("rel_path", F.col("n_sections").alias("n_ranges"), "text")


def q_tree_profile(spark, sf):
    return ext_profile(scan_tree(spark, written_tree(spark, sf)))


def q_single_bundle(spark, sf):
    """The page plan with all pages in one document."""
    pages, sites = table(spark, sf, "pages"), host_sites(spark, sf)
    parts = bundle_pages(pages, sites, ["page_id"], mode="single", hosted=True, part_bytes=PART_BYTES)
    return parts.select("file_name", "part_no", "n_sections", "byte_offset", "text")


# --- schedule and rules ----------------------------------------------------------


def request_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as requests; arrival in microseconds without any session time zone."""
    ts = F.col("ts")
    seconds = F.unix_date(ts.cast("date")).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    micros = (F.extract(F.lit("SECONDS"), ts) * 1_000_000).cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id", "user_id", (seconds * 1_000_000 + micros).alias("arrival_us")
    )


def q_throttle_schedule(spark, sf):
    return throttle_schedule(
        request_table(spark, sf), "user_id", "arrival_us", "event_id", TWO_DAYS_RATE, 2
    )


def q_throttle_shared(spark, sf):
    """One bucket for all requests."""
    return throttle_schedule(request_table(spark, sf), None, "arrival_us", "event_id", 1 / 300, 3)


def q_throttle_thirds(spark, sf):
    """Three requests per second: an interval that is no whole number of microseconds."""
    dense = request_table(spark, sf).withColumn("arrival_us", F.expr("arrival_us div 1000000"))
    return throttle_schedule(dense, None, "arrival_us", "event_id", 3, 2)


def policy_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as a table of policies, many of them broken."""
    key = F.col("c_custkey")
    site = F.struct(
        F.when(key % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("https://"), "c_name")).alias("base_url")
    )
    return table(spark, sf_dir, "customer").select(
        key,
        F.when(key % 5 == 0, strings()).otherwise(F.array("c_mktsegment")).alias("file_extensions"),
        F.when(key % 3 == 0, F.array().cast("array<struct<base_url:string>>"))
        .otherwise(F.array(site)).alias("sites"),
        F.element_at(strings("", "single", "separate", "zip"), (key % 4).cast("int") + 1).alias("output_type"),
        F.col("c_acctbal").alias("requests_per_second"),
        (F.col("c_nationkey") - 3).alias("burst_limit"),
    )


def q_rule_violations(spark, sf):
    return rule_violations(policy_table(spark, sf), "c_custkey")


def q_selector_violations(spark, sf):
    """Host sites, some of them with a selector that is not plain."""
    host = F.regexp_replace("base_url", "^https://", "")
    sites = host_sites(spark, sf).withColumn(
        "css_locator", F.when(host.startswith("m."), F.lit("p:first-child")).otherwise(F.lit("article"))
    )
    return selector_violations(sites)


QUERIES = {name[2:]: fn for name, fn in list(globals().items()) if name.startswith("q_")}
