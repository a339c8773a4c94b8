"""Stored pages by URL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_pages(spark: SparkSession, path: str, format: str = "parquet") -> DataFrame:
    """A page table (page_id, url, html) in any format Spark reads."""
    return spark.read.format(format).load(path).select("page_id", "url", "html")


def failed(results: DataFrame) -> DataFrame:
    return results.filter(F.col("error").isNotNull())


def succeeded(results: DataFrame) -> DataFrame:
    return results.filter(F.col("error").isNull())
