"""Checks over tables of policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Accepted output types and the messages, in the order they are checked.
OUTPUT_TYPES = ("single", "separate")
MESSAGES = (
    "file_extensions or sites must be specified",
    "output_type must be 'single' or 'separate'",
    "requests_per_second must be positive",
    "burst_limit must be positive",
    "base_url must be specified for each site",
)


def _empty(items: Column) -> Column:
    return F.coalesce(F.size(items), F.lit(0)) <= 0


def violations(
    file_extensions: Column,
    sites: Column,
    output_type: Column,
    requests_per_second: Column,
    burst_limit: Column,
) -> Column:
    """Array of (check_no, message) for the broken rules of one policy, in check order."""
    kind = F.coalesce(output_type, F.lit(""))
    nameless = F.exists(sites, lambda s: F.coalesce(s["base_url"], F.lit("")) == "")
    broken = (
        _empty(file_extensions) & _empty(sites),
        ~kind.isin("", *OUTPUT_TYPES),
        requests_per_second <= 0,
        burst_limit <= 0,
        nameless,
    )
    found = F.array(
        *(
            F.when(test, F.struct(F.lit(i).alias("check_no"), F.lit(text).alias("message")))
            for i, (test, text) in enumerate(zip(broken, MESSAGES), start=1)
        )
    )
    return F.filter(found, lambda v: v.isNotNull())


def rule_violations(policies: DataFrame, *ids: str) -> DataFrame:
    """One row per broken rule: the ids, ``check_no``, ``message`` and whether it comes first."""
    found = violations(
        F.col("file_extensions"), F.col("sites"), F.col("output_type"),
        F.col("requests_per_second"), F.col("burst_limit"),
    )
    return policies.select(*ids, F.posexplode(found).alias("pos", "v")).select(
        *ids, "v.check_no", "v.message", (F.col("pos") == 0).alias("is_first")
    )


def selector_violations(sites: DataFrame) -> DataFrame:
    """Site and override selectors with a pseudo-class or a sibling, for tables whose rules are to be plain."""
    none = F.array().cast("array<string>")
    overrides = F.col("path_overrides")
    used = F.flatten(
        F.array(
            F.array(F.coalesce("css_locator", F.lit(""))),
            F.coalesce("exclude_selectors", none),
            F.coalesce(F.transform(overrides, lambda o: F.coalesce(o["css_locator"], F.lit(""))), none),
            F.coalesce(F.flatten(F.transform(overrides, lambda o: F.coalesce(o["exclude_selectors"], none))), none),
        )
    )
    return sites.select("base_url", F.explode(F.array_distinct(used)).alias("selector")).filter(
        F.regexp_replace("selector", r"\[[^\]]*\]", "").rlike("[:+~]")
    )
