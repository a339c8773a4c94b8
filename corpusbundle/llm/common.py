"""Helpers that several operators of this package share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbundle.operators.durable import durable_table
from corpusbundle.operators.keys import flagged, slot_bitmap

__all__ = ["bounded_batches", "durable_table", "flagged", "slot_bitmap", "slots", "spread_join", "table", "text_of"]


#: Rows of an Arrow batch of whole texts, where the session leaves Spark's default.
BATCH_ROWS = 1_000

_BATCH_CONF, _BATCH_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def bounded_batches(df: DataFrame) -> None:
    """Have Arrow batches hold fewer rows than Spark's default, which is made for narrow ones.

    A batch of whole texts exists once in the JVM and once in the Python worker of each
    task. A value that the session sets itself is left alone.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_CONF) == _BATCH_DEFAULT:
        conf.set(_BATCH_CONF, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str | Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def slots(spark: SparkSession) -> int:
    """How many hot keys a join may broadcast: four for each shuffle partition."""
    return 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread_join(rows: DataFrame, groups: DataFrame, key: str, weight: str) -> DataFrame:
    """Inner join of rows with one row per key, whatever share of the rows one key holds.

    ``weight`` is the column of ``groups`` that counts the key's rows. Keys with more
    than a quarter of a mean partition are joined by broadcast; there are at most four
    per shuffle partition, so that side has a bound. All other keys meet in a shuffle.
    Both inputs are read twice: pass written tables.
    """
    most = slots(rows.sparkSession)
    total = groups.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) * F.lit(most) >= F.lit(total)
    hot = F.broadcast(groups.filter(heavy))
    apart = rows.join(F.broadcast(groups.filter(heavy).select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(apart.join(groups.filter(~heavy), key))
