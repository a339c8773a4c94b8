"""Connected components of a table of links, by alternating stars.

Each round replaces links by links to smaller nodes until every component is a star
around its smallest node. All rounds are joins and grouped minima; the links of a round
are a written table, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusbundle.llm.common import durable_table, spread_join


def _least(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (u, v), and for each u the smallest v and the number of its links."""
    groups = durable_table(links.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    return links, groups


def _large_star(links: DataFrame) -> DataFrame:
    both = durable_table(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))))
    rows, groups = _least(both)
    joined = spread_join(rows, groups, "u", "n").filter("v > u")
    return durable_table(joined.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    rows, groups = _least(links)
    moved = spread_join(rows, groups, "u", "n").filter("v != m")
    joined = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = groups.select("u", F.col("m").alias("v"))
    return durable_table(joined.unionByName(own).filter("u != v").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node that has a link; root is the smallest node of its component.

    ``links`` has two columns of one comparable type, in any direction; null ends and
    links of a node with itself are left out.
    """
    a, b = links.columns
    current = durable_table(
        links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    )
    state = None
    while True:
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state or now[0] == 0:
            break
        state = tuple(now)
        current = _small_star(_large_star(current))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return durable_table(current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots))
