"""Flows, ticks and scans that don't meet in one task, against a packet-by-packet simulation."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import flows as fl
from flowloom.operators import ordered

SCHEMA = "seq long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, length int, tcp_flags int"


def simulated(rows, idle, active, every, as_of=None):
    """Every packet is counted and then looks at all open flows, in order of arrival."""
    held, done, ticks, numbers = {}, [], [], {}

    def look(now):
        for key, f in list(held.items()):
            if now - f["start"] >= active or now - f["last"] >= idle:
                done.append((key, f["no"], f["n"], f["start"], f["last"], "expired_active" if now - f["start"] >= active else "expired_idle"))
                del held[key]
            elif now - f["start"] >= every and now - f["tick"] >= every:
                f["tick"], f["ticks"] = now, f["ticks"] + 1
                ticks.append((key, f["no"], f["ticks"], now, f["n"], f["bytes"]))

    for _, ts, src, dst, sp, dp, protocol, length, _ in rows:
        key = (*min((src, sp), (dst, dp)), *max((src, sp), (dst, dp)), protocol)
        if key not in held:
            held[key] = {"no": numbers.get(key, 0), "n": 0, "bytes": 0, "start": ts, "tick": ts, "ticks": 0}
            numbers[key] = held[key]["no"] + 1
        held[key].update(n=held[key]["n"] + 1, bytes=held[key]["bytes"] + length, last=ts)
        look(ts)
    if as_of is not None:
        look(as_of)
    done += [(k, f["no"], f["n"], f["start"], f["last"], "expired_flush") for k, f in held.items()]
    return done, ticks


def made(rnd, n, hosts, step):
    ts, rows = 1000.0, []
    for seq in range(n):
        ts += rnd.choice([0, 0, step, step, 3 * step, 20 * step if rnd.random() < 0.05 else step])
        a, b = rnd.randrange(hosts), rnd.randrange(2)
        ends = [(f"10.0.0.{a}", 4000), ("1.1.1.1", 80 + b)]
        (src, sp), (dst, dp) = rnd.sample(ends, 2)
        rows.append((seq, ts, src, dst, sp, dp, 6, 40 + seq % 9, 0))
    return rows


@pytest.mark.parametrize(("hosts", "step", "block"), [(3, 0.7, 1 << 18), (2, 0.4, 16), (1, 2.0, 7)])
def test_flows_and_ticks_equal_a_simulation(spark, monkeypatch, hosts, step, block):
    monkeypatch.setattr(fl, "ARRIVALS", block)
    rows = made(random.Random(hosts), 400, hosts, step)
    packets = spark.createDataFrame(rows, SCHEMA).repartition(3)
    as_of = rows[-1][1] + 11
    flows, ticks = simulated(rows, 15.0, 40.0, 5.0, as_of)
    ids = {r["flow_id"]: (r["ip_a"], r["port_a"], r["ip_b"], r["port_b"], r["protocol"]) for r in fl.keyed(packets).select(*fl.KEY, fl.net.flow_id().alias("flow_id")).distinct().collect()}
    got = fl.build_by_clock(packets, 15.0, 40.0, as_of=as_of, width=30.0).collect()
    assert sorted((ids[r["flow_id"]], r["flow_no"], r["total_packets"], r["start_time"], r["end_time"], r["state"]) for r in got) == sorted(flows)
    got = fl.ticks(packets, 15.0, 40.0, 5.0, as_of=as_of, width=30.0).collect()
    assert sorted((ids[r["flow_id"]], *tuple(r)[1:]) for r in got) == sorted(ticks)
    numbers = fl.numbered(packets, 15.0, 40.0)
    assert numbers.count() == len(rows)
    counts = numbers.groupBy(*fl.KEY, "flow_no").count().collect()
    assert sorted((tuple(r)[:5], r["flow_no"], r["count"]) for r in counts) == sorted(f[:3] for f in flows)
    assert fl.numbered(packets.limit(0)).count() == 0 and fl.ticks(packets.limit(0)).count() == 0


def test_one_five_tuple_over_many_tasks(spark, monkeypatch):
    """2**18 packets of one five-tuple, 0.01 s apart: 9 flows of the active limit, split in blocks of 2**15 arrivals."""
    monkeypatch.setattr(fl, "ARRIVALS", 1 << 15)
    n = 1 << 18
    packets = spark.range(0, n, 1, 8).select(
        F.col("id").alias("seq"), (1000 + F.col("id") / 100).alias("ts"), F.lit("10.0.0.1").alias("src_ip"), F.lit("10.0.0.2").alias("dst_ip"),
        F.lit(1).alias("src_port"), F.lit(2).alias("dst_port"), F.lit(6).alias("protocol"), F.lit(50).alias("length"), F.lit(0).alias("tcp_flags"),
    )
    flows = sorted((r["start_time"], r["total_packets"]) for r in fl.build_by_clock(packets).collect())
    start, want = 0, []
    while start < n:  # the packet after the one that crosses the limit starts the next flow
        end = min(start + 30_001, n)
        want.append((1000 + start / 100, end - start))
        start = end
    assert flows == want
    parts = fl._pieces(fl.clocked(fl.keyed(packets)), 15.0)[0].groupBy(ordered.BLOCK).count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) == 1 << 15


def test_halos_hold_what_windows_need(spark):
    rows = [(g, i, (i * 7919) % 101) for g, n in (("a", 95), ("b", 3), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, v int").withColumn(ordered.BLOCK, F.floor(F.col("i") / 11))
    held = ordered.with_halo(df, ["g"], ["i"], reach=4, size=10).collect()
    for g, n in (("a", 95), ("b", 3), ("c", 1)):
        for b in range(-(-n // 10)):
            own = sorted(r["i"] for r in held if r["g"] == g and r[ordered.BLOCK] == b and not r["__halo"])
            before = sorted(r["i"] for r in held if r["g"] == g and r[ordered.BLOCK] == b and r["__halo"])
            assert own == list(range(10 * b, min(n, 10 * b + 10))) and before == list(range(max(0, 10 * b - 4), 10 * b))
    got = {(r["g"], r["i"]): r["p"] for r in ordered.with_before(df, ["g"], ["i"], "v", "p").collect()}
    assert got == {(g, i): (i - 1) * 7919 % 101 if i else None for g, i, _ in rows}
