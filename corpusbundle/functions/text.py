"""Section rendering and text clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white space that trimming removes.
WHITE_SPACE = (
    "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

GENERATED_NOTE = " (Code-generated, Read-only)"


def strip(col: Column) -> Column:
    """Trim Unicode white space on both sides (``trim`` alone removes spaces only)."""
    return F.btrim(col, F.lit(WHITE_SPACE))


def non_blank(col: Column) -> Column:
    return col.rlike(f"[^{WHITE_SPACE}]")


def normalize_extract(col: Column) -> Column:
    """Trim, turn CRLF and CR into LF, trim every line; blank inner lines stay."""
    unix = F.replace(F.replace(strip(col), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    lines = F.transform(F.split(unix, "\n"), strip)
    return F.btrim(F.array_join(lines, "\n"), F.lit("\n"))


def generated_note(generated: Column) -> Column:
    return F.when(generated, F.lit(GENERATED_NOTE)).otherwise(F.lit(""))


def file_section(path: Column, note: Column, ext: Column, content: Column) -> Column:
    """Heading, note and fenced content; nothing inside the content is escaped."""
    return F.concat(
        F.lit("# File: "), path, note, F.lit("\n\n```"), ext, F.lit("\n"), content, F.lit("```\n\n")
    )


def page_section(url: Column, content: Column) -> Column:
    return F.concat(F.lit("## "), url, F.lit("\n\n"), content, F.lit("\n\n"))


def content_length(col: Column) -> Column:
    """Length in bytes."""
    return F.octet_length(col).cast("long")
