"""Release times of packets that are sent again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.operators import ordered


def paced(packets: DataFrame, mbps: float, start: float) -> DataFrame:
    """Adds release_ts, when a packet has been sent at `mbps` (counted from 0), and live_ts, its time moved so that the first packet's is `start`.

    Bytes are summed in order of arrival over a tree of sums; the first packet's time is one row for all.
    """
    rows = ordered.with_running(packets, "seq", {"__sent": F.col("length").cast("long")})
    first = packets.agg(F.min_by("ts", "seq").alias("__t0"))
    rows = rows.join(F.broadcast(first))
    return rows.withColumns({"release_ts": F.col("__sent") * 8 / (mbps * 1e6), "live_ts": start + F.greatest(F.lit(0.0), F.col("ts") - F.col("__t0"))}).drop("__sent", "__t0")
