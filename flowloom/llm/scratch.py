"""Tables that cut lineage, in the folder that every node of the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def root(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a temporary folder, for a local master only."""
    global _local_root
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="spark-scratch-")
    return _local_root


def place(spark: SparkSession, label: str) -> str:
    return f"{root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    The copy survives lost executors, so later jobs never recompute what is above it. Files stay until the
    shared folder is cleaned: results that read them are lazy, so only the caller knows when they are done with.
    """
    path = place(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
