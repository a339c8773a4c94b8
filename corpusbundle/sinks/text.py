"""Bundles as ordered text parts, written in parallel to any file system Spark writes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbundle.functions.text import page_section
from corpusbundle.operators.bundles import PART_BYTES
from corpusbundle.operators.durable import durable, durable_table
from corpusbundle.plans.files import FilePolicy, part_listing, read_sections
from corpusbundle.plans.web import filled_groups, with_file_names
from corpusbundle.sources.trees import CHUNK_BYTES, unreadable


def write_ordered(
    sections: DataFrame,
    path: str,
    order: Sequence[str],
    text: str,
    by: Sequence[str] = (),
    parts: int | None = None,
) -> None:
    """Write sections so that the part files, in name order, make the document.

    One range shuffle on (by, order) and a sort inside each task; no document is
    ever held whole. The sections are written once first, because a range shuffle reads
    its input twice. Every section must end in a newline: that one is left to the
    writer. With ``by`` each group gets a directory of its own.
    """
    keys = [*by, *order]
    line = F.regexp_replace(F.col(text), r"\n\z", "").alias("value")
    (
        durable_table(sections.select(*keys, text))
        .repartitionByRange(*([parts] if parts else []), *keys)
        .sortWithinPartitions(*keys)
        .select(*by, line)
        .write.partitionBy(*by)
        .text(path)
    )


def write_tree_bundle(
    spark: SparkSession,
    root: str,
    path: str,
    policy: FilePolicy,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Bundle a file tree: each task reads and writes the files that start in its part.

    Parts are cut by bytes, and no content crosses a shuffle. Large files are written line
    by line, or in runs of lines. Returns the files that could not be opened.
    """
    listing = part_listing(spark, root, policy, part_bytes)
    errors = durable(unreadable(listing, root))
    sections = read_sections(listing, root, min(part_bytes, CHUNK_BYTES), whole_lines=True)
    kept = sections.filter(F.col("read_error").isNull())
    kept.select(F.regexp_replace("section", r"\n\z", "").alias("value")).write.text(path)
    return errors


def write_combined_pages(converted: DataFrame, content: str, path: str) -> None:
    """All pages as one document in URL order."""
    sections = converted.filter(F.col(content).isNotNull()).select(
        "url", page_section(F.col("url"), F.col(content)).alias("section")
    )
    write_ordered(sections, path, ["url"], "section")


def write_grouped_pages(grouped: DataFrame, path: str) -> None:
    """One directory per group of ``plans.web.grouped_pages``, named like its file.

    Contents are parted by an empty line, and the document ends with one too.
    """
    grouped = durable_table(grouped)
    named = with_file_names(filled_groups(grouped), grouped, ["url"])
    sections = named.withColumn("section", F.concat("content", F.lit("\n\n")))
    write_ordered(sections, path, ["url"], "section", by=["file_name"])


def write_profile(policy: DataFrame, path: str) -> None:
    """A generated policy (one row) as JSON."""
    policy.write.json(path)
