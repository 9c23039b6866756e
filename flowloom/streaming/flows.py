"""Flows from an endless stream of packets.

`build` keeps state by five-tuple and closes by event time; what is later than the watermark is dropped. `follow` drops nothing: packets of
open flows are a stored table that each batch joins, late packets among them, so its flows are those of `operators.flows.build_by_clock`.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowloom.operators import flows as fl
from flowloom.operators.flows import KEY, keyed

_STATE = "src_ip string, dst_ip string, src_port int, dst_port int, packets_fwd long, packets_bwd long, bytes_fwd long, bytes_bwd long, start_time double, end_time double"
_KEY = "ip_a string, port_a int, ip_b string, port_b int, protocol int"
_NAMES = [c.split()[0] for c in _STATE.split(", ")]


def _opened(p: tuple) -> list:
    return [p.src_ip, p.dst_ip, p.src_port, p.dst_port, 0, 0, 0, 0, p.ts, p.ts]


def _fold(idle: float, active: float):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flow, done = (list(state.get) if state.exists else None), []
        if state.hasTimedOut:
            done.append((*key, *flow, "expired_idle"))
            flow = None
        else:
            # A trigger's packets of one five-tuple, in order of arrival; sources bound what a trigger takes.
            for p in pd.concat(list(frames)).sort_values("seq").itertuples(index=False):
                if flow is not None and p.ts - flow[9] >= idle:
                    done.append((*key, *flow, "expired_idle"))
                    flow = None
                flow = flow or _opened(p)
                side = 0 if p.is_forward else 1
                flow[4 + side] += 1
                flow[6 + side] += int(p.length)
                flow[9] = p.ts
                if p.ts - flow[8] >= active:
                    done.append((*key, *flow, "expired_active"))
                    flow = None
        if flow is None:
            state.remove()
        else:
            state.update(tuple(flow))
            state.setTimeoutTimestamp(max(int((flow[9] + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=[*KEY, *_NAMES, "state"])

    return run


def build(packets: DataFrame, idle: float = 15.0, active: float = 300.0, late: str = "10 seconds") -> DataFrame:
    """Closed flows of a stream of packets (append mode).

    A flow closes at its own packet that reaches `active`, before its own packet that comes `idle` or more after the
    last, or when the watermark (`late` behind the newest packet of all traffic) passes its last packet by `idle`.
    The watermark stands for the clock of all traffic; what is open when the query stops stays in its state.
    """
    rows = keyed(packets).withColumn("event_time", F.timestamp_micros((F.col("ts") * 1_000_000).cast("long"))).withWatermark("event_time", late)
    out = rows.groupBy(*KEY).applyInPandasWithState(_fold(idle, active), f"{_KEY}, {_STATE}, state string", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return out.withColumns({"duration": F.col("end_time") - F.col("start_time"), "total_packets": F.col("packets_fwd") + F.col("packets_bwd"), "total_bytes": F.col("bytes_fwd") + F.col("bytes_bwd")})


def follow(packets: DataFrame, path: str, checkpoint: str, idle: float = 15.0, active: float = 300.0, drain: bool = True) -> StreamingQuery:
    """Closed flows of a stream of packets below path, as if all had been there at once; `flows` reads them.

    Each batch joins the packets of flows still open, which no flow holds for longer than `active`, and the clock so far. A packet later than
    others of its flow changes that flow's counters while it is open; once it is closed, it starts another. A batch that runs again overwrites what it left.
    """
    keep = ["seq", "ts", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "length", "tcp_flags", *KEY[:4], "is_forward", "clock"]

    def store(batch: DataFrame, number: int) -> None:
        spark, high = batch.sparkSession, None
        if number:
            high = spark.read.parquet(f"{path}/clock/batch={number - 1}").first()[0]
        rows = fl.clocked(keyed(batch), start=high).select(*keep)
        if number:
            rows = rows.unionByName(spark.read.schema(rows.schema).parquet(f"{path}/open/batch={number - 1}"))
        found = fl.numbered_by_clock(rows, idle, active)
        clock = batch.agg(F.greatest(F.max("ts"), F.lit(high).cast("double")).alias("clock"))
        clock.write.mode("overwrite").parquet(f"{path}/clock/batch={number}")
        high = spark.read.parquet(f"{path}/clock/batch={number}").first()[0]
        by_active, by_idle = F.col("start_time") + active, F.col("end_time") + idle
        flows = fl.summed(found).withColumn("open", F.lit(high).cast("double").isNull() | (F.least(by_active, by_idle) > F.lit(high)))
        flows.write.mode("overwrite").parquet(f"{path}/flows/batch={number}")
        open_ = spark.read.parquet(f"{path}/flows/batch={number}").where("open").select("flow_start")
        found.join(open_, "flow_start", "left_semi").select(*keep).write.mode("overwrite").parquet(f"{path}/open/batch={number}")

    writer = packets.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if drain else writer.trigger(processingTime="2 seconds")).start()


def flows(spark: SparkSession, path: str) -> DataFrame:
    """The flows that `follow` has stored: all closed ones, and those open after the last batch (column open)."""
    rows = spark.read.parquet(f"{path}/flows")
    last = rows.agg(F.max("batch")).first()[0]
    return rows.where(~F.col("open") | (F.col("batch") == last)).drop("batch", "flow_no")
