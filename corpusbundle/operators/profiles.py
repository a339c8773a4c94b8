"""Grouped summaries of files and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbundle.functions.globs import file_ext, is_text_ext


def ext_profile(listing: DataFrame) -> DataFrame:
    """Text extensions present, with file counts and sizes, sorted by name.

    At most one row per known text extension leaves the partial aggregation.
    """
    return (
        listing.select(file_ext(F.col("rel_path")).alias("ext"), "size")
        .filter(is_text_ext(F.col("ext")))
        .groupBy("ext")
        .agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("total_bytes"))
        .orderBy("ext")
    )


def run_summary(results: DataFrame, *by: str) -> DataFrame:
    """Requested and answered URLs per group from rows (by..., url, content).

    Counting per URL first keeps a group with most of the rows spread out and
    needs no row expansion for the two distinct counts.
    """
    per_url = results.groupBy(*by, "url").agg(
        F.max(F.col("content").isNotNull().cast("int")).alias("_answered"),
        F.sum(F.octet_length("content").cast("long")).alias("_bytes"),
    )
    return per_url.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_urls"),
        F.sum("_answered").alias("n_with_content"),
        F.sum("_bytes").alias("content_bytes"),
    )
