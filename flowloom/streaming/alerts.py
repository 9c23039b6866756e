"""Suppression of repeated alerts, source baselines and stores that follow a stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from flowloom.operators.alerts import FLOOR


def _timed(rows: DataFrame, ts: str, late: str) -> DataFrame:
    return rows.withColumn("event_time", F.timestamp_micros((F.col(ts) * 1_000_000).cast("long"))).withWatermark("event_time", late)


def _types(rows: DataFrame) -> StructType:
    return StructType([f for f in rows.schema.fields if f.name != "event_time"])


def deduplicate(candidates: DataFrame, window: float = 30.0, late: str = "10 seconds") -> DataFrame:
    """As operators.alerts.deduplicate, over a stream. Only the last time of each (source, destination, class) is kept, and dropped
    once the watermark is two windows beyond it, when it can no longer suppress anything in time order."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["ts", "alert_id"])
        ts = rows["ts"].to_numpy()
        before = np.concatenate([[state.get[0] if state.exists else -np.inf], ts[:-1]])
        state.update((float(ts[-1]),))
        state.setTimeoutTimestamp(max(int((ts[-1] + 2 * window) * 1000), state.getCurrentWatermarkMs() + 1))
        yield rows[ts - before >= window].drop(columns=["event_time", "__class"])

    kept = candidates.where(F.col("confidence") >= FLOOR)
    rows = _timed(kept.withColumn("__class", F.lower("threat_class")), "ts", late)
    return rows.groupBy("src_ip", "dst_ip", "__class").applyInPandasWithState(run, _types(kept), "last double", "append", GroupStateTimeout.EventTimeTimeout)


class _Baseline(StatefulProcessor):
    """Per source: its last `window` outbound volumes and the destinations it has been seen with; both lapse when unused."""

    def __init__(self, window: int, lapse_ms: int, columns: list[str]):
        self.window, self.lapse_ms, self.columns = window, lapse_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.past = handle.getListState("past", StructType().add("bytes", "double"), self.lapse_ms)
        self.seen = handle.getMapState("seen", StructType().add("dst_ip", "string"), StructType().add("n", "long"), self.lapse_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        got = pd.concat(list(rows)).sort_values(["start_time", "seq"])
        past = [r[0] for r in self.past.get()]
        known: dict[str, bool] = {}
        scores, novel = [], []
        for b, dst in zip(got["bytes_fwd"].astype(float), got["dst_ip"], strict=True):
            mean, spread = (np.mean(past), np.std(past)) if len(past) >= 2 else (0.0, None)
            scores.append(0.0 if spread is None else (b - mean) / spread if spread >= 1e-9 else np.inf if b > mean else 0.0)
            past = [*past, b][-self.window :]
            novel.append(0 if known.get(dst) or self.seen.containsKey((dst,)) else 1)
            known[dst] = True
        self.past.put([(b,) for b in past])
        for dst in known:
            self.seen.updateValue((dst,), (1,))
        yield got.assign(outbound_volume_zscore=scores, destination_novel=novel)[self.columns]

    def close(self) -> None:
        pass


def with_baseline(flows: DataFrame, window: int = 100, lapse: float = 30 * 86_400.0) -> DataFrame:
    """Adds outbound_volume_zscore, each flow's bytes against the last `window` flows of its source, and destination_novel, over a stream.

    A source's volumes lapse `lapse` seconds (of processing) after its last flow, a destination as long after it was last seen, so state shrinks with what is
    active; until then both columns are those of the batch form. Needs the state store of `session.prepare`.
    """
    types = StructType([*flows.schema.fields]).add("outbound_volume_zscore", "double").add("destination_novel", "integer")
    return flows.groupBy("src_ip").transformWithStateInPandas(_Baseline(window, int(lapse * 1000), types.names), types, "append", "ProcessingTime")


def per_minute(alerts: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Alerts of each minute and class, once the watermark has passed it."""
    return _timed(alerts, "ts", late).groupBy(F.window("event_time", "1 minute"), "threat_class").agg(F.count("*").alias("n")).select(F.unix_timestamp("window.start").alias("minute"), "threat_class", "n")


def follow(rows: DataFrame, path: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, drain: bool = True, empty_batches: bool = True) -> StreamingQuery:
    """Appends every batch as Parquet below path, in a folder of its own that a repeated batch overwrites, then calls `each`.

    With drain, the query ends when all that is there now has been taken. Readers find all batches at path. Without empty_batches, none runs where nothing
    new has come: states that lapse by processing time, as those of `with_baseline`, would ask for such batches for ever.
    """

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")
        if each is not None:
            each(batch.sparkSession.read.parquet(f"{path}/batch={number}"), number)

    writer = rows.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime="2 seconds")
    conf, name = rows.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(name)
    conf.set(name, str(empty_batches).lower())
    try:
        return writer.start()
    finally:
        conf.set(name, before)
