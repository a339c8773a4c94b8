"""Path predicates: extension lists and glob lists compiled to one regex each.

Patterns are policy (a handful of strings held by the driver), so a whole list
becomes a single anchored Java regex that runs inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions counted as text when profiling a tree.
TEXT_EXTENSIONS = (
    "txt", "md", "go", "py", "js", "html", "css",
    "json", "xml", "yaml", "yml", "toml", "ini",
    "sh", "bash", "zsh", "fish",
    "c", "cpp", "h", "hpp", "java", "kt", "scala",
    "rs", "rb", "php", "ts", "swift",
)

NEVER = r"[^\s\S]"


class BadPattern(ValueError):
    """A glob that can never match because its syntax is broken."""


def _literal(ch: str) -> str:
    return ch if ch.isalnum() or ord(ch) > 127 else "\\" + ch


def _class_regex(pattern: str, i: int) -> tuple[str, int]:
    """Regex for the bracket expression opened just before ``i``; returns (regex, next)."""

    def member(j: int) -> tuple[str, int]:
        if j < len(pattern) and pattern[j] == "\\":
            j += 1
        elif j < len(pattern) and pattern[j] in "-]":
            raise BadPattern(pattern)
        if j >= len(pattern):
            raise BadPattern(pattern)
        return pattern[j], j + 1

    negated = pattern[i : i + 1] == "^"
    i += negated
    ranges: list[str] = []
    seen = False
    while not (seen and pattern[i : i + 1] == "]"):
        low, i = member(i)
        high = low
        if pattern[i : i + 1] == "-":
            high, i = member(i + 1)
        if low <= high:
            ranges.append(f"{_literal(low)}-{_literal(high)}")
        seen = True
    if not ranges:
        return (r"[\s\S]" if negated else NEVER), i + 1
    return f"[{'^' if negated else ''}{''.join(ranges)}]", i + 1


def wildcard_regex(pattern: str, class_spans_slash: bool = False) -> str:
    """Regex for ``*``, ``?``, ``[...]`` and backslash escapes within one path segment."""
    out: list[str] = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif ch == "[":
            fragment, i = _class_regex(pattern, i)
            out.append(fragment if class_spans_slash else f"(?!/){fragment}")
        elif ch == "\\":
            if i >= len(pattern):
                raise BadPattern(pattern)
            out.append(_literal(pattern[i]))
            i += 1
        else:
            out.append(_literal(ch))
    return "".join(out)


def glob_regex(pattern: str) -> str:
    """Unanchored regex for a slash-separated glob.

    A segment that is exactly ``**`` swallows any run of characters and takes no
    slash of its own; every other segment covers one path segment, and the last
    one tolerates a trailing slash.
    """
    segments = pattern.split("/")
    last = len(segments) - 1
    out = []
    for i, segment in enumerate(segments):
        if segment == "**":
            out.append(".*")
        else:
            out.append(wildcard_regex(segment) + ("/" if i < last else "/?"))
    return "".join(out)


def _any_of(fragments: Iterable[str]) -> str:
    kept = list(fragments)
    return rf"(?s)\A(?:{'|'.join(kept)})\z" if kept else NEVER


def _each(patterns: Iterable[str], build) -> Iterable[str]:
    for pattern in patterns:
        if pattern == "":
            continue
        try:
            yield build(pattern)
        except BadPattern:
            continue


def ignore_regex(patterns: Iterable[str]) -> str:
    """With ``**`` the whole path must match; otherwise any leading run of segments may."""

    def build(pattern: str) -> str:
        if "**" in pattern:
            return glob_regex(pattern)
        return f"(?:{wildcard_regex(pattern, class_spans_slash=True)})(?:/.*)?"

    return _any_of(_each(patterns, build))


def generated_regex(patterns: Iterable[str]) -> str:
    """With ``**`` the whole path must match; otherwise only the base name, at any depth."""

    def build(pattern: str) -> str:
        if "**" in pattern:
            return glob_regex(pattern)
        return NEVER if "/" in pattern else f"(?:.*/)?{wildcard_regex(pattern)}"

    return _any_of(_each(patterns, build))


def glob_match(path: Column, pattern: str) -> Column:
    return path.rlike(_any_of(_each([pattern], glob_regex)))


#: Kinds of patterns and what each means for a list of them.
PATTERN_KINDS = {
    "glob": lambda patterns: _any_of(_each(patterns, glob_regex)),
    "ignore": ignore_regex,
    "generated": generated_regex,
}


def matches_regex(path: Column, regex: Column) -> Column:
    """Does a path match the regex of its own row? False where there is no regex."""
    return F.coalesce(F.regexp_like(path, regex), F.lit(False))


def is_ignored(path: Column, patterns: Iterable[str]) -> Column:
    return path.rlike(ignore_regex(patterns))


def is_generated(path: Column, patterns: Iterable[str]) -> Column:
    return path.rlike(generated_regex(patterns))


def in_hidden_dir(path: Column) -> Column:
    """True below a directory whose own name starts with a dot; hidden files are not affected."""
    return path.rlike(r"(^|/)\.[^/]*/")


def file_ext(path: Column) -> Column:
    """Text after the last dot of the last segment, ``''`` when there is none."""
    return F.regexp_extract(path, r"\.([^./]*)\z", 1)


def ext_in(path: Column, types: Iterable[str]) -> Column:
    dotted = F.regexp_extract(path, r"\.[^./]*\z", 0)
    return dotted.isin([f".{t}" for t in types])


def is_text_ext(ext: Column) -> Column:
    return ext.isin(list(TEXT_EXTENSIONS))


def tree_key(path: Column) -> Column:
    """Sort key for walk order: names sorted within each directory, contents in place.

    Comparing this string byte by byte equals comparing the list of segments,
    because no name can hold NUL; unlike an array it gets the prefix sort.
    """
    return F.replace(path, F.lit("/"), F.lit("\x00"))
