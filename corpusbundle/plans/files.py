"""File trees, or tables of files, to bundles."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbundle.functions.globs import (
    ext_in,
    file_ext,
    in_hidden_dir,
    is_generated,
    is_ignored,
    tree_key,
)
from corpusbundle.functions.names import BUNDLE_SUFFIX
from corpusbundle.functions.text import file_section, generated_note
from corpusbundle.operators.bundles import PART_BYTES, assembled, assign_parts, bundle_parts
from corpusbundle.operators.durable import durable
from corpusbundle.sources.trees import (
    CHUNK_BYTES,
    read_content,
    read_ranges,
    scan_tree,
    split_ranges,
    unreadable,
)

# Extensions bundled when none are named.
DEFAULT_TYPES = ("go", "md", "txt")


@dataclass(frozen=True)
class FilePolicy:
    """Which files to bundle: extensions without dot, and two lists of globs.

    ``skip_bundles`` leaves out files that are named like earlier bundles.
    """

    types: Sequence[str] = DEFAULT_TYPES
    ignore: Sequence[str] = ()
    generated: Sequence[str] = ()
    skip_bundles: bool = False

    def ignored(self) -> list[str]:
        earlier = [f"**/*{BUNDLE_SUFFIX}"] if self.skip_bundles else []
        return [*self.ignore, *earlier]


def select_files(files: DataFrame, policy: FilePolicy) -> DataFrame:
    """Files of the wanted types that are neither ignored nor below a hidden directory."""
    path = F.col("rel_path")
    return files.filter(
        ext_in(path, policy.types) & ~is_ignored(path, policy.ignored()) & ~in_hidden_dir(path)
    )


def tag_files(files: DataFrame, policy: FilePolicy) -> DataFrame:
    """Add ``ext``, ``generated``, ``note`` and the walk-order key ``tree_key``."""
    path = F.col("rel_path")
    return files.withColumns(
        {
            "ext": file_ext(path),
            "generated": is_generated(path, policy.generated),
            "tree_key": tree_key(path),
        }
    ).withColumn("note", generated_note(F.col("generated")))


def file_sections(files: DataFrame, policy: FilePolicy) -> DataFrame:
    """Selected files with content as rendered ``section`` rows; rows without content are left out."""
    section = file_section(F.col("rel_path"), F.col("note"), F.col("ext"), F.col("content"))
    return (
        tag_files(select_files(files, policy), policy)
        .filter(F.col("content").isNotNull())
        .withColumn("section", section)
        .drop("content")
    )


def bundle_table(
    files: DataFrame,
    policy: FilePolicy,
    by: Sequence[str] = (),
    tie: Sequence[str] = (),
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Bundle a table (by..., rel_path, content) into one document per group, in walk order.

    ``tie`` names columns that tell rows of one path apart, if paths can repeat.
    """
    sections = file_sections(files, policy)
    return bundle_parts(sections, list(by), ["tree_key", *tie], "section", part_bytes=part_bytes)


def tree_listing(spark: SparkSession, root: str, policy: FilePolicy) -> DataFrame:
    """The listing a bundle of ``root`` is made from, with tags and order but no contents."""
    found = scan_tree(spark, root, prune_hidden=True, skip_under=policy.ignored())
    return tag_files(select_files(found, policy), policy)


def read_sections(
    listing: DataFrame, root: str, chunk_bytes: int = CHUNK_BYTES, whole_lines: bool = False
) -> DataFrame:
    """Read the listed files where their rows are and render them, large ones in several rows."""
    return _rendered(read_content(listing, root, chunk_bytes, whole_lines), "chunk_no")


def _rendered(read: DataFrame, number: str) -> DataFrame:
    """Rows of read files as sections: the first has what stands before a file's text, the last what follows."""
    empty = F.lit("")
    whole = file_section(F.col("rel_path"), F.col("note"), F.col("ext"), F.lit("\0"))
    head, tail = F.substring_index(whole, "\0", 1), F.substring_index(whole, "\0", -1)
    section = F.concat(
        F.when(F.col(number) == 0, head).otherwise(empty),
        "content",
        F.when(F.col("is_last"), tail).otherwise(empty),
    )
    return read.withColumn("section", section).drop("content")


def _by_part(listing: DataFrame, order: Sequence[str], part_bytes: int) -> DataFrame:
    """Listing rows, those that start in one part in one partition and in order.

    Listing rows are tiny next to the bytes they stand for, so partitions follow the bytes
    behind the rows.
    """
    placed = durable(assign_parts(listing, [], order, "size", part_bytes=part_bytes))
    parts = placed.agg(F.max("part_no")).first()[0]
    by_part = placed.repartitionById((parts or 0) + 1, F.col("part_no").cast("int"))
    return by_part.sortWithinPartitions("ordinal")


def part_listing(
    spark: SparkSession, root: str, policy: FilePolicy, part_bytes: int = PART_BYTES
) -> DataFrame:
    """The listing, the files that start in part p in partition p and in order."""
    return _by_part(tree_listing(spark, root, policy), ["tree_key"], part_bytes)


def part_ranges(
    spark: SparkSession, root: str, policy: FilePolicy, part_bytes: int = PART_BYTES
) -> DataFrame:
    """``part_listing`` with a row for each range of a file, so that a large file is read by many tasks."""
    ranges = split_ranges(tree_listing(spark, root, policy), min(part_bytes, CHUNK_BYTES))
    return _by_part(ranges, ["tree_key", "range_no"], part_bytes)


class TreeBundle(NamedTuple):
    """The parts of a bundle, and the files that are missing from it with the reason."""

    parts: DataFrame
    errors: DataFrame


def bundle_tree(
    spark: SparkSession, root: str, policy: FilePolicy, part_bytes: int = PART_BYTES
) -> TreeBundle:
    """Bundle a file tree as rows (part_no, piece_no, n_sections, byte_offset, text), with its errors.

    Only listing rows are shuffled; the task that owns a part reads the ranges of files that
    start in it. Offsets are those of the listed sizes and only order the parts.
    """
    ranges = part_ranges(spark, root, policy, part_bytes)
    sections = _rendered(read_ranges(ranges, root), "range_no")
    rows = sections.select(
        "part_no", "byte_offset", F.col("section").alias("text"), (F.col("range_no") == 0).alias("is_start")
    )
    parts = rows.mapInArrow(
        assembled(part_bytes),
        "part_no long, piece_no long, n_sections long, byte_offset long, text string",
    )
    return TreeBundle(parts, unreadable(ranges.filter("range_no = 0"), root))
