"""Cutting lineage so that every reader of an intermediate sees the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local run may fall back to a new one."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = spark.conf.get(_CONF, None)
        if shared is None:
            if not context.master.startswith("local"):
                raise RuntimeError(f"set {_CONF} to a folder every executor can reach")
            shared = tempfile.mkdtemp(prefix="corpusbundle-checkpoint-")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint narrow rows whose values depend on how they were partitioned.

    After an executor is lost, a recomputed range partitioning could otherwise
    number rows anew.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def durable_table(df: DataFrame) -> DataFrame:
    """Write wide, costly rows once as a columnar table; readers take only their columns."""
    path = f"{shared_dir(df.sparkSession)}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Delete the tables this application wrote; nothing that reads them may run afterwards."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tables")
    path.getFileSystem(conf).delete(path, True)
