"""Output names, titles and size labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusbundle.functions.text import strip
from corpusbundle.functions.urls import url_host, url_path

BUNDLE_SUFFIX = ".bundle.md"


def _trim_char(col: Column, ch: str) -> Column:
    return F.regexp_replace(col, rf"\A{ch}+|{ch}+\z", "")


def sanitize_name(name: Column) -> Column:
    """Runs of anything but letters, digits, dash and underscore become ``_``."""
    cleaned = _trim_char(F.regexp_replace(name, r"[^a-zA-Z0-9_\-]+", "_"), "_")
    return F.when(cleaned == "", F.lit("untitled")).otherwise(cleaned)


def sanitize_dashed(name: Column) -> Column:
    """Runs of anything but letters and digits become ``-``; no default name."""
    return _trim_char(F.regexp_replace(name, r"[^a-zA-Z0-9]+", "-"), "-")


def normalize_url_path(path: Column) -> Column:
    return sanitize_dashed(_trim_char(path, "/"))


def html_title(html: Column) -> Column:
    """Raw text between the first ``<title>`` and the first ``</title>``; null when out of order."""
    start = F.locate("<title>", html)
    end = F.locate("</title>", html)
    return F.when(
        (start > 0) & (end > start), F.substring(html, start + 7, end - start - 7)
    )


def page_filename(html: Column, url: Column, suffix: str = BUNDLE_SUFFIX) -> Column:
    """Name from the trimmed title, else from host and path; null when the URL has no host."""
    title = F.nullif(strip(html_title(html)), F.lit(""))
    path = url_path(url)
    host = F.nullif(url_host(url), F.lit(""))
    from_url = F.concat(
        host, F.when(path == "/", F.lit("")).otherwise(F.regexp_replace(path, r"/\z", ""))
    )
    return F.concat(sanitize_name(F.coalesce(title, from_url)), F.lit(suffix))


def page_filename_error(html: Column, url: Column) -> Column:
    """Why ``page_filename`` is null, else null."""
    titled = F.coalesce(strip(html_title(html)), F.lit("")) != ""
    host = url_host(url)
    return F.when(~titled & host.isNull(), F.lit("invalid URL")).when(
        ~titled & (host == ""), F.lit("invalid URL: missing host")
    )


def page_filename_dashed(html: Column, url: Column) -> Column:
    """Name from the untrimmed title (even an empty one), else from the whole URL."""
    return F.concat(sanitize_dashed(F.coalesce(html_title(html), url)), F.lit(".md"))


def bundle_name(project: Column, at: Column, suffix: str = BUNDLE_SUFFIX) -> Column:
    return F.concat(project, F.lit("-"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit(suffix))


def group_file_name(prefix: Column, path: Column) -> Column:
    """``<prefix or doc>-<normalised path or index>.md``."""
    blank = F.lit("")
    return F.concat(
        F.coalesce(F.nullif(prefix, blank), F.lit("doc")),
        F.lit("-"),
        F.coalesce(F.nullif(normalize_url_path(path), blank), F.lit("index")),
        F.lit(".md"),
    )


def human_size(size: Column) -> Column:
    """``N B`` under 1024, else one decimal and a binary unit, ties to even."""
    label = F.concat(size.cast("string"), F.lit(" B"))
    for power, unit in enumerate("KMGTPE", start=1):
        scaled = F.bround(size.cast("double") / F.lit(float(1024**power)), 1)
        label = F.when(
            size >= 1024**power, F.format_string("%.1f %sB", scaled, F.lit(unit))
        ).otherwise(label)
    return label
