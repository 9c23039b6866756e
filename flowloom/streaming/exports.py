"""Flow export datagrams and moving means over streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from flowloom.sources import netflow

_FILE = "path string, modificationTime timestamp, length long, content binary"


def datagrams(spark: SparkSession, path: str, files_per_trigger: int = 10_000) -> DataFrame:
    """A stream of datagrams that a receiver drops as files into a folder, one each, under ascending numbers."""
    files = spark.readStream.format("binaryFile").schema(_FILE).option("maxFilesPerTrigger", files_per_trigger).load(path)
    return files.select(F.regexp_extract("path", r"([0-9]+)[^/0-9]*$", 1).try_cast("long").alias("seq"), F.col("content").alias("data"))


def _known(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(frames)).sort_values(["seq", "pos"])
    known = rows["announced"].ffill()
    if state.exists:
        known = known.fillna(state.get[0])
    rows["template"] = known.where(known.notna(), None)
    if rows["template"].iloc[-1] is not None:
        state.update((rows["template"].iloc[-1],))
    yield rows.loc[rows["body"].notna() & rows["template"].notna(), ["seq", "pos", "source_id", "template_id", "export_time", "body", "template"]]


def records(stream: DataFrame) -> DataFrame:
    """As sources.netflow.records, over a stream of (seq, data): templates of earlier batches stay known.

    The state of each (source, template) is its last definition; definitions never expire. Data that come before any is lost.
    """
    rows = stream.select("seq", F.posexplode(netflow.walked("data")).alias("pos", "s")).select("seq", "pos", "s.*")
    announced = F.when(F.col("fields").isNotNull(), F.to_json(F.struct("record_length", "fields")))
    rows = rows.select("seq", "pos", "source_id", "template_id", "export_time", "body", announced.alias("announced"))
    out = rows.groupBy("source_id", "template_id").applyInPandasWithState(
        _known, "seq long, pos int, source_id long, template_id int, export_time long, body binary, template string", "template string", "append", GroupStateTimeout.NoTimeout
    )
    parsed = F.from_json("template", "record_length int, fields array<struct<type:int,at:int,size:int>>")
    return netflow.cut(out.withColumn("template", parsed).where("template.record_length > 0"))


def ewma(rows: DataFrame, key: str, order: str, value: str, alpha: float = 0.3) -> DataFrame:
    """Adds `ewma`, the moving mean of value up to each row of its key; the first value counts whole. The state is one number."""

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        got, mean, means = pd.concat(list(frames)).sort_values(order), (state.get[0] if state.exists else None), []
        for v in got[value].astype(float):
            mean = v if mean is None else alpha * v + (1 - alpha) * mean
            means.append(mean)
        state.update((mean,))
        yield got.assign(ewma=means)

    return rows.groupBy(key).applyInPandasWithState(run, StructType([*rows.schema.fields]).add("ewma", "double"), "mean double", "append", GroupStateTimeout.NoTimeout)
