"""Bidirectional flows from packets, and what follows from their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions import net
from flowloom.operators import ordered
from flowloom.operators.ordered import BLOCK
from flowloom.written import written

KEY = ["ip_a", "port_a", "ip_b", "port_b", "protocol"]
#: Arrival numbers that are ordered together: no task holds more packets of a five-tuple, however hot.
ARRIVALS = 1 << 18


def keyed(packets: DataFrame) -> DataFrame:
    key = net.flow_key()
    return packets.select("*", *key[:4], key[5])


def build(packets: DataFrame, idle: float = 15.0) -> DataFrame:
    """Flows of each five-tuple, split where a packet comes `idle` seconds or more after the one before it (in order of arrival).

    Packets are split and summed within blocks of arrivals; what blocks have of one flow is joined over partial flows, so packets are
    exchanged once and no five-tuple's packets meet in one task.
    """
    by = Window.partitionBy(*KEY, BLOCK).orderBy("seq")
    rows = keyed(packets).withColumn(BLOCK, F.floor(F.col("seq") / ARRIVALS))
    rows = rows.withColumn("__new", (F.col("ts") - F.lag("ts").over(by) >= idle).cast("int"))
    rows = rows.withColumn("__part", F.coalesce(F.sum("__new").over(by), F.lit(0)))
    parts = rows.groupBy(*KEY, BLOCK, "__part").agg(*_sums())
    order = Window.partitionBy(*KEY).orderBy(BLOCK, "__part")
    parts = parts.withColumn("__new", (F.col("start_time") - F.lag("end_time").over(order) >= idle).cast("int"))
    parts = parts.withColumn("flow_no", F.coalesce(F.sum("__new").over(order), F.lit(0)))
    return _shown(_joined(parts, [*KEY, "flow_no"]))


def latest(events: DataFrame, key: str, order: str) -> DataFrame:
    """The last row per key: what an upsert would leave."""
    return events.groupBy(key).agg(F.max_by(F.struct(*(c for c in events.columns if c != key)), order).alias("__last")).select(key, "__last.*")


def ewma(df: DataFrame, groups: list[str], order: list[str], value: str, alpha: float = 0.3, block: int = 1 << 16) -> DataFrame:
    """Running mean that gives the newest value the weight alpha; per group the last one. It starts anew after a null.

    Rows are weighted within blocks of the first (numeric) order column; only one row a block is ordered over a whole group.
    """
    rows = df.select(*groups, *order, F.col(value).cast("double").alias("__v"), F.floor(F.col(order[0]) / block).alias("__b"))
    newest = Window.partitionBy(*groups, "__b").orderBy(*(F.desc(c) for c in order), F.desc("__v"))
    rows = rows.withColumns({"__after": F.row_number().over(newest) - 1, "__nulls": F.count_if(F.col("__v").isNull()).over(newest.rowsBetween(Window.unboundedPreceding, 0))})
    counts = F.col("__nulls") == 0
    sums = rows.groupBy(*groups, "__b").agg(
        F.coalesce(F.sum(F.when(counts, alpha * F.pow(F.lit(1 - alpha), "__after") * F.col("__v"))), F.lit(0.0)).alias("__s"), F.count_if(counts).alias("__n"),
        F.max((~counts).cast("int")).alias("__cut"), F.min_by("__v", F.when(counts, F.struct(*order, "__v"))).alias("__first"),
    )
    later = Window.partitionBy(*groups).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"__after": F.coalesce(F.sum("__n").over(later), F.lit(0)), "__cuts": F.coalesce(F.sum("__cut").over(later), F.lit(0))})
    lives = (F.col("__cuts") == 0) & (F.col("__n") > 0)
    whole = F.sum(F.when(lives, F.col("__s") * F.pow(F.lit(1 - alpha), "__after")))
    first = F.min_by("__first", F.when(lives, F.col("__b"))) * F.pow(F.lit(1 - alpha), F.sum(F.when(lives, F.col("__n"))))
    return sums.groupBy(*groups).agg((whole + first).alias("ewma"))


def clocked(packets: DataFrame, block: int = ARRIVALS, start: float | None = None) -> DataFrame:
    """Adds `clock`: the latest time of the packets that arrived before, of any flow, and of `start` (null for the first without it).

    Windows run within blocks of arrival numbers; only one row a block is ordered over all.
    """
    rows = packets.withColumn("__b", F.floor(F.col("seq") / block))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("__b").agg(F.max("ts").alias("__last")).select("__b", F.max("__last").over(before(Window.orderBy("__b"))).alias("__before"))
    within = F.max("ts").over(before(Window.partitionBy("__b").orderBy("seq")))
    rows = rows.withColumn("__own", within).join(ends, "__b")
    return rows.withColumn("clock", F.greatest("__own", "__before", F.lit(start).cast("double"))).drop("__b", "__own", "__before")


def _pieces(rows: DataFrame, idle: float) -> tuple[DataFrame, DataFrame]:
    """From packets with keys and clock: packets with BLOCK and __part, and per (key, BLOCK, __part), the piece of a block between idle splits: its packets' sums and __seg.

    A flow is idle when any packet arrives `idle` after its last one, so the clock of all traffic decides; __seg, the arrival number of the first packet
    since such a split, names what lies between two of them.
    """
    rows = rows.withColumn(BLOCK, F.floor(F.col("seq") / ARRIVALS))
    by = Window.partitionBy(*KEY, BLOCK).orderBy("seq")
    rows = rows.withColumn("__new", (F.col("clock") - F.lag("ts").over(by) >= idle).cast("int"))
    rows = rows.withColumn("__part", F.coalesce(F.sum("__new").over(by), F.lit(0))).drop("__new")
    pieces = rows.groupBy(*KEY, BLOCK, "__part").agg(*_sums(), F.min_by("clock", "seq").alias("__clock"), F.max("clock").alias("__until"))
    order = Window.partitionBy(*KEY).orderBy(BLOCK, "__part")
    before = F.lag("end_time").over(order)
    pieces = pieces.withColumn("__head", F.when(before.isNull() | (F.col("__clock") - before >= idle), F.col("__seq")))
    pieces = pieces.withColumn("__seg", F.last("__head", ignorenulls=True).over(order)).drop("__head", "__clock")
    return rows, written(pieces, "flow-pieces")


def _starts(rows: DataFrame, pieces: DataFrame, active: float) -> tuple[DataFrame, DataFrame]:
    """Packets (with __seg) of segments that the active limit may split, and where flows start in them: (__seg, __at).

    The next start after a packet is the first packet of its segment with `active` or more on the clock since; which packets are starts
    follows from the segment's first one, along these steps.
    """
    long = pieces.groupBy("__seg").agg(F.min("start_time").alias("__t"), F.max("__until").alias("__until")).where(F.col("__until") >= F.col("__t") + active).select("__seg")
    cut = rows.join(pieces.join(long, "__seg").select(*KEY, BLOCK, "__part", "__seg"), [*KEY, BLOCK, "__part"])
    cut = written(cut, "flow-long")
    points = cut.select("__seg", "seq", "ts")
    steps = ordered.following(points, F.col("ts") + active, cut, F.col("clock"), F.col("seq"), ["__seg"], active)
    steps = steps.select(F.col("seq").alias("__from"), F.col("found.tag").alias("__to")).where("__to > __from")
    return cut, ordered.reached(long.select("__seg", F.col("__seg").alias("__at")), steps, "__at")


def _with_start(cut: DataFrame, starts: DataFrame) -> DataFrame:
    """Packets of long segments with __flow, the arrival number of their flow's first packet."""
    marked = cut.join(starts.select(F.col("__at").alias("seq"), F.col("__at").alias("__mark")), "seq", "left")
    return ordered.with_totals(marked, ["__seg"], ["seq"], {"__flow": F.col("__mark")}, F.max).drop("__mark")


def numbered(packets: DataFrame, idle: float = 15.0, active: float = 300.0) -> DataFrame:
    """Packets with the number of their flow, closed by the clock of all traffic, and `flow_start`, its first packet's arrival number.

    A flow closes when any packet arrives `active` after its start or `idle` after its last packet; the packet that
    crosses the active limit itself still counts. Late packets don't set the clock back: one whose flow
    is open counts in it, else it starts a flow; after it the flow's idle time is counted from its time, against the clock as it stands.
    """
    return numbered_by_clock(clocked(keyed(packets)), idle, active)


def numbered_by_clock(rows: DataFrame, idle: float, active: float) -> DataFrame:
    """`numbered` for packets that have their keys and `clock` already. Of each key, they begin where a flow does."""
    rows, pieces = _pieces(rows, idle)
    cut, starts = _starts(rows, pieces, active)
    long = starts.select("__seg").distinct()
    short = rows.join(pieces.join(long, "__seg", "left_anti").select(*KEY, BLOCK, "__part", F.col("__seg").alias("__flow")), [*KEY, BLOCK, "__part"])
    out = written(short.unionByName(_with_start(cut, starts).select(*short.columns)).withColumnRenamed("__flow", "flow_start").drop(BLOCK, "__part"), "flow-packets")
    flows = out.groupBy(*KEY, "flow_start").agg(F.count("*").alias("__n"))
    numbers = flows.select("flow_start", (F.row_number().over(Window.partitionBy(*KEY).orderBy("flow_start")) - 1).cast("long").alias("flow_no"))
    return out.join(numbers, "flow_start")


def summed(rows: DataFrame) -> DataFrame:
    """One row per flow of numbered packets; partial sums leave each task, not packets."""
    return _shown(_joined(rows.groupBy(*KEY, "flow_start", "flow_no").agg(*_sums()), [*KEY, "flow_start", "flow_no"]), "flow_start")


def _sums() -> list:
    """Partial sums of one flow's packets: what `_joined` adds up."""
    fwd = F.col("is_forward")
    return [
        F.min("seq").alias("__seq"), F.max("seq").alias("__last"), F.min_by(F.struct("src_ip", "dst_ip", "src_port", "dst_port"), "seq").alias("__first"),
        F.count_if(fwd).alias("packets_fwd"), F.count_if(~fwd).alias("packets_bwd"),
        F.sum(F.when(fwd, F.col("length")).otherwise(0)).alias("bytes_fwd"), F.sum(F.when(fwd, 0).otherwise(F.col("length"))).alias("bytes_bwd"),
        F.min_by("ts", "seq").alias("start_time"), F.max_by("ts", "seq").alias("end_time"),
    ]


def _joined(parts: DataFrame, groups: list[str]) -> DataFrame:
    """One row per group of partial flows."""
    return parts.groupBy(*groups).agg(
        F.min_by("__first", "__seq").alias("__first"), *(F.sum(c).alias(c) for c in ("packets_fwd", "packets_bwd", "bytes_fwd", "bytes_bwd")),
        F.min_by("start_time", "__seq").alias("start_time"), F.max_by("end_time", "__last").alias("end_time"), F.min("__seq").alias("first_seq"),
    )


def _shown(flows: DataFrame, *more: str) -> DataFrame:
    return flows.select(
        net.flow_id().alias("flow_id"), "flow_no", "__first.*", "protocol", "packets_fwd", "packets_bwd", "bytes_fwd", "bytes_bwd",
        (F.col("packets_fwd") + F.col("packets_bwd")).alias("total_packets"), (F.col("bytes_fwd") + F.col("bytes_bwd")).alias("total_bytes"),
        "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"), "first_seq", *more,
    )


def closing(flows: DataFrame, times: DataFrame, idle: float, active: float, width: float) -> DataFrame:
    """Flows with closed_at, the first of times (ts) at which the flow is found closed (null if none), and state.

    expired_active if the active limit was reached by then, else expired_idle; expired_flush for what is open at the end.
    """
    limit = F.least(F.col("start_time") + active, F.col("end_time") + idle)
    found = ordered.following(flows, limit, times.select("ts").distinct(), F.col("ts"), F.lit(0), [], width).withColumn("closed_at", F.col("found.at")).drop("found")
    state = F.when(F.col("closed_at").isNull(), "expired_flush").when(F.col("closed_at") >= F.col("start_time") + active, "expired_active").otherwise("expired_idle")
    return found.withColumn("state", state)


def _times(packets: DataFrame, as_of: float | None) -> DataFrame:
    """The times at which flows are looked at: those of packets, and as_of where it isn't earlier."""
    times = packets.select("ts")
    if as_of is None:
        return times
    return times.union(packets.agg(F.greatest(F.max("ts"), F.lit(float(as_of))).alias("ts")).where("ts IS NOT NULL"))


def build_by_clock(packets: DataFrame, idle: float = 15.0, active: float = 300.0, as_of: float | None = None, width: float = 3600.0) -> DataFrame:
    """Flows closed by the clock of all traffic, with `closed_at` and `state` at the end of input, or after a look at `as_of`, if that is later.

    What no active limit splits is summed by blocks and joined; only packets of longer segments are looked at again. Times may fall in order of arrival
    (late packets), but closed_at and state of a flow that a late packet starts are as if it had come in time.
    """
    rows, pieces = _pieces(clocked(keyed(packets)), idle)
    cut, starts = _starts(rows, pieces, active)
    short = pieces.join(starts.select("__seg").distinct(), "__seg", "left_anti").withColumn("__flow", F.col("__seg"))
    more = _with_start(cut, starts).groupBy(*KEY, "__flow").agg(*_sums())
    flows = _joined(short.select(*more.columns).unionByName(more), [*KEY, "__flow"])
    flows = flows.withColumn("flow_no", (F.row_number().over(Window.partitionBy(*KEY).orderBy("__flow")) - 1).cast("long"))
    return closing(_shown(flows), _times(packets, as_of), idle, active, width)


def ticks(packets: DataFrame, idle: float = 15.0, active: float = 300.0, every: float = 1.0, as_of: float | None = None, width: float = 3600.0) -> DataFrame:
    """Snapshots of open flows on the clock of all traffic: flow_id, flow_no, tick (from 1), at, and the counters of packets until then.

    Every packet looks at all open flows: one is due when `every` has passed since its start and since its last tick, unless it closes just then.
    When the next tick comes depends on the time of the last one alone, so one table of successors of times serves all flows.
    """
    rows = written(numbered(packets, idle, active), "tick-packets")
    flows = rows.groupBy("flow_start", *KEY, "flow_no").agg(F.min_by("ts", "seq").alias("start_time"), F.max_by("ts", "seq").alias("end_time"))
    times = written(_times(rows, as_of).distinct(), "tick-times")
    flows = closing(flows.select("flow_start", net.flow_id().alias("flow_id"), "flow_no", "start_time", "end_time"), times, idle, active, width)
    steps = ordered.following(times, F.col("ts") + every, times, F.col("ts"), F.lit(0), [], width).select(F.col("ts").alias("__from"), F.col("found.at").alias("__to"))
    open_ = F.col("closed_at").isNull() | (F.col("__to") < F.col("closed_at"))
    found = ordered.reached(flows.select("flow_start", "flow_id", "flow_no", "start_time", "closed_at", F.col("start_time").alias("at")), steps, "at", open_)
    found = found.where("at > start_time")
    # A tick counts packets up to the first one of its time, which arrives at __seq; blocks are as long as ticks are apart.
    firsts = rows.groupBy("ts").agg(F.min("seq").alias("__seq")).withColumnRenamed("ts", "__ts")
    found = found.join(firsts, F.col("at") == F.col("__ts"), "left").select("flow_start", "flow_id", "flow_no", "at", "__seq", F.lit(1).alias("__tick"))
    of_flow = rows.select("flow_start", F.col("ts").alias("at"), F.col("seq").alias("__seq"), F.lit(0).alias("__tick"), F.col("length").cast("long").alias("__bytes"))
    both = found.unionByName(of_flow, allowMissingColumns=True).withColumn(BLOCK, F.floor(F.col("at") / every))
    both = both.withColumn("__seq", F.coalesce("__seq", F.lit((1 << 63) - 1)))  # a look at as_of comes after all packets
    counts = {"tick": F.col("__tick"), "total_packets": 1 - F.col("__tick"), "total_bytes": F.coalesce("__bytes", F.lit(0))}
    both = ordered.with_totals(both, ["flow_start"], ["__seq", "__tick"], {n: c.cast("long") for n, c in counts.items()})
    return both.where("__tick = 1").select("flow_id", "flow_no", "tick", "at", "total_packets", "total_bytes")


def lifetime(flows: DataFrame) -> DataFrame:
    """Packets seen, flows created, expired and still open."""
    still = F.col("state") == "expired_flush"
    return flows.agg(F.coalesce(F.sum("total_packets"), F.lit(0)).alias("packets"), F.count("*").alias("created"), F.count_if(~still).alias("expired"), F.count_if(still).alias("active"))
