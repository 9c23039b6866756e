"""What a session needs before queries run on it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """UTC, bounded Arrow batches, and this package on the path of Python workers (which inherit no import path of their own)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    # Lists and maps of streams' states, and their lapse, need this store.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    # Python workers give memory of large buffers back when these are freed, whatever long texts came before.
    spark.sparkContext.environment.update(ARROW_DEFAULT_MEMORY_POOL="system", MALLOC_MMAP_THRESHOLD_="1048576", MALLOC_ARENA_MAX="2")
    home = str(Path(__file__).resolve().parent.parent)
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(":")
    if home not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = ":".join([home, *filter(None, paths)])
    return spark
