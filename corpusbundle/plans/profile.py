"""A starting policy derived from what a tree holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbundle.operators.profiles import ext_profile

# Paths ignored by a generated policy.
DEFAULT_IGNORE = ("node_modules/**", "vendor/**", ".git/**")


def generated_policy(listing: DataFrame) -> DataFrame:
    """One row: sorted text extensions present and the fixed ignore list.

    The listing should come from ``scan_tree(prune_hidden=False)``. At most one
    row per known text extension reaches the final aggregate.
    """
    return ext_profile(listing).agg(
        F.array_sort(F.collect_set("ext")).alias("file_extensions"),
        F.array(*map(F.lit, DEFAULT_IGNORE)).alias("ignore_paths"),
    )
