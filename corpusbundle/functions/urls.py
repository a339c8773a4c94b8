"""URL parts and per-site rule look-ups, all as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*:"
_HOST = r"(?:\[[^\]/?#]*\]|[^\s:/?#@\[\]\\^`{|}]*)(?::[0-9]*)?"
_BROKEN = r"%(?![0-9A-Fa-f]{2})"
# One pass over the URL checks it and cuts it up: group 1 is the host with port,
# group 2 the undecoded path. Refused are control characters, a malformed host,
# broken escapes, and a colon in the first segment of a relative path. What
# follows a scheme without a slash is opaque and has no path.
_URL = (
    r"(?s)\A(?!.*[\x00-\x1f\x7f])"
    rf"(?:{_SCHEME}(?:(?!/)[^?#]*)?|(?![^/?#]*:))"
    rf"(?://(?:[^/?#]*@)?({_HOST})(?=[/?#]|\z)|(?!//))"
    rf"(?![^?#]*{_BROKEN})([^?#]*)"
    rf"(?:\?[^#]*)?(?:#(?!.*{_BROKEN}).*)?\z"
)


def _part(url: Column, group: int) -> Column:
    """A group of the URL pattern as an array of one, or of none if it does not match."""
    return F.regexp_extract_all(url, F.lit(_URL), F.lit(group))


def url_path(url: Column) -> Column:
    """Decoded path; ``''`` when there is none, null when the URL cannot be parsed.

    A plus sign stays a plus sign.
    """
    decoded = F.transform(
        _part(url, 2),
        lambda p: F.when(
            p.contains("%"), F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B")))
        ).otherwise(p),
    )
    return F.try_element_at(decoded, F.lit(1))


def url_host(url: Column) -> Column:
    """Host with port and without user info; null when the URL cannot be parsed."""
    return F.try_element_at(_part(url, 1), F.lit(1))


def _prefix_hits(path: Column, rules: Column, prefix=lambda r: r) -> Column:
    """One boolean per rule: does its prefix start the path?

    The path is repeated beside the rules instead of being captured by the
    lambda, so it is worked out once per row and not once per rule.
    """
    repeated = F.array_repeat(path, F.size(rules))
    return F.zip_with(repeated, rules, lambda p, r: F.startswith(p, prefix(r)))


def _first(rules: Column, hits: Column) -> Column:
    return F.try_element_at(rules, F.nullif(F.array_position(hits, True), F.lit(0)).cast("int"))


def any_prefix(path: Column, prefixes: Column) -> Column:
    return F.coalesce(F.array_contains(_prefix_hits(path, prefixes), True), F.lit(False))


def first_prefix(path: Column, prefixes: Column) -> Column:
    """First element, in list order, that prefixes ``path``; null when none does."""
    return _first(prefixes, _prefix_hits(path, prefixes))


def path_allowed(path: Column, allowed: Column, excluded: Column) -> Column:
    """Under some allowed prefix and under no excluded one."""
    return any_prefix(path, allowed) & ~any_prefix(path, excluded)


def url_allowed(url: Column, base_url: Column, allowed: Column, excluded: Column) -> Column:
    """Same host as the site, and its path is allowed."""
    same_host = F.coalesce(url_host(url) == url_host(base_url), F.lit(False))
    return same_host & path_allowed(url_path(url), allowed, excluded)


def resolve_override(
    path: Column, css: Column, excludes: Column, overrides: Column
) -> tuple[Column, Column]:
    """(css, excludes) in force for a URL path.

    The first override whose path prefixes it wins; its excludes replace the
    site's even when empty, its selector only when not empty.
    """
    hit = _first(overrides, _prefix_hits(path, overrides, lambda o: o["path"]))
    none = F.array().cast("array<string>")
    own_css = F.nullif(hit["css_locator"], F.lit(""))
    own_excludes = F.when(hit.isNotNull(), F.coalesce(hit["exclude_selectors"], none))
    return F.coalesce(own_css, css, F.lit("")), F.coalesce(own_excludes, excludes, none)


def matched_path(
    path: Column, allowed: Column, base_path: Column | None = None, strict: bool = False
) -> Column:
    """First allowed path that prefixes the URL path, else null.

    With ``base_path`` the allowed paths are taken relative to the site's own
    path. ``strict`` treats an empty allowed path as no match.
    """
    if base_path is not None:
        path = F.when(
            F.startswith(path, base_path), F.substr(path, F.length(base_path) + F.lit(1))
        )
    hit = first_prefix(path, allowed)
    return F.nullif(hit, F.lit("")) if strict else hit
