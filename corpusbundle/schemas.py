"""Explicit schemas of rule and policy tables."""

from __future__ import annotations

from pyspark.sql import types as T

STRINGS = T.ArrayType(T.StringType())

OVERRIDE = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("css_locator", T.StringType()),
        T.StructField("exclude_selectors", STRINGS),
    ]
)

SITES_SCHEMA = T.StructType(
    [
        T.StructField("base_url", T.StringType()),
        T.StructField("css_locator", T.StringType()),
        T.StructField("exclude_selectors", STRINGS),
        T.StructField("allowed_paths", STRINGS),
        T.StructField("exclude_paths", STRINGS),
        T.StructField("file_name_prefix", T.StringType()),
        T.StructField("path_overrides", T.ArrayType(OVERRIDE)),
    ]
)

POLICY_SCHEMA = T.StructType(
    [
        T.StructField("file_extensions", STRINGS),
        T.StructField("ignore_paths", STRINGS),
        T.StructField("code_generated_paths", STRINGS),
        T.StructField("sites", T.ArrayType(SITES_SCHEMA)),
        T.StructField("output_type", T.StringType()),
        T.StructField("requests_per_second", T.DoubleType()),
        T.StructField("burst_limit", T.IntegerType()),
    ]
)

LISTING_SCHEMA = T.StructType(
    [
        T.StructField("rel_path", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("mtime", T.TimestampType()),
    ]
)
