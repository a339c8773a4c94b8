"""Site rules and the seed URLs they stand for."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbundle.schemas import SITES_SCHEMA


def sites_table(spark: SparkSession, rules: Iterable[Mapping]) -> DataFrame:
    """Rule dictionaries as a table; unknown keys are ignored, missing ones become null."""
    names = SITES_SCHEMA.fieldNames()
    return spark.createDataFrame([{n: r.get(n) for n in names} for r in rules], SITES_SCHEMA)


def sites_from_urls(
    urls: DataFrame, css: str = "", excludes: Sequence[str] = ()
) -> DataFrame:
    """One pseudo-site per URL of a table with a ``url`` column, allowing just that page."""
    values = {
        "base_url": F.col("url"),
        "css_locator": F.lit(css),
        "exclude_selectors": F.array(*map(F.lit, excludes)),
        "allowed_paths": F.array(F.lit("")),
    }
    return urls.select(
        *(
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in SITES_SCHEMA.fields
        )
    )


def seed_urls(sites: DataFrame) -> DataFrame:
    """(url, path, path_no, site): base URL and allowed path put together, paths in order."""
    return sites.select(
        F.struct("*").alias("site"), F.posexplode("allowed_paths").alias("path_no", "path")
    ).select(F.concat("site.base_url", "path").alias("url"), "path", "path_no", "site")
