"""Streams against their batch forms, and states against hand-made histories."""

import pytest
from pyspark.sql import functions as F

from flowloom.fixtures import view
from flowloom.operators import alerts, features
from flowloom.streaming import alerts as live
from flowloom.streaming import flows as live_flows

SF = "/root/testdata/sf0.001"
BASE = 1_200_000.0


def stream(spark, tmp_path, rows, order, parts=3):
    """The rows as a stream of files in order, one a trigger."""
    import os

    cuts = rows.approxQuantile(order, [i / parts for i in range(1, parts)], 0.0)
    edges = [float("-inf"), *cuts, float("inf")]
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        rows.where((F.col(order) > a) & (F.col(order) <= b)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        for name in os.listdir(tmp_path / "in"):
            if name.endswith(".parquet") and not name.startswith("t"):
                os.rename(tmp_path / "in" / name, tmp_path / "in" / f"t{i}.parquet")
                os.utime(tmp_path / "in" / f"t{i}.parquet", (1e9 + i * 60, 1e9 + i * 60))
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def drained(spark, tmp_path, rows, each=None, empty_batches=True):
    query = live.follow(rows, str(tmp_path / "out"), str(tmp_path / "check"), each, empty_batches=empty_batches)
    query.awaitTermination(240)
    assert not query.isActive and query.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


def test_dedup_equals_batch(spark, tmp_path):
    rows = view(spark, SF, "alerts").cache()
    seen = []
    got = drained(spark, tmp_path, live.deduplicate(stream(spark, tmp_path, rows, "ts"), 2_592_000.0), lambda b, i: seen.append(b.count()))
    want = alerts.deduplicate(rows, 2_592_000.0)
    key = lambda df: sorted(r["alert_id"] for r in df.select("alert_id").collect())
    assert key(got) == key(want) and sum(seen) == want.count()


def test_baseline_equals_batch(spark, tmp_path):
    rows = view(spark, SF, "flows").cache()
    got = drained(spark, tmp_path, live.with_baseline(stream(spark, tmp_path, rows, "start_time")), empty_batches=False)
    both = lambda df: {r["seq"]: (r["outbound_volume_zscore"], r["destination_novel"]) for r in df.select("seq", "outbound_volume_zscore", "destination_novel").collect()}
    want, found = both(features.exfiltration(rows)), both(got)
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_baselines_lapse(spark, tmp_path):
    """A pause longer than the lapse between two runs: the source's past and destinations are forgotten, and its state is gone."""
    import time

    rows = [(i, "a", "x", 100 + i % 3, float(i)) for i in range(20)] + [(20, "a", "x", 9000, 20.0)]
    df = spark.createDataFrame(rows, "seq long, src_ip string, dst_ip string, bytes_fwd long, start_time double")

    def run(name, part, lapse, pause):
        df.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        live_rows = live.with_baseline(spark.readStream.schema(df.schema).parquet(str(tmp_path / name / "in")), lapse=lapse)
        query = live.follow(live_rows, str(tmp_path / name / "out"), str(tmp_path / name / "check"), empty_batches=False)
        query.awaitTermination(240)
        assert not query.isActive and query.exception() is None
        time.sleep(pause)

    for name, lapse, pause in (("kept", 3600.0, 0), ("lapsed", 1.0, 3)):
        run(name, "seq < 20", lapse, pause)
        run(name, "seq = 20", lapse, pause)
        last = spark.read.parquet(str(tmp_path / name / "out")).where("seq = 20").first()
        assert (last["destination_novel"], last["outbound_volume_zscore"] > 3) == ((0, True) if name == "kept" else (1, False))


def test_late_packets_count(spark, tmp_path):
    """Packets behind all others, in batches of their own, change the counters of open flows; all flows equal the batch form's."""
    import random

    from flowloom.operators import flows as fl

    rnd, ts, rows, late = random.Random(3), BASE, [], 0
    for seq in range(400):
        ts += rnd.choice([0.5, 1.0, 2.0, 9.0])
        behind = seq % 4 == 3 and rnd.random() < 0.7  # the next packet is in time again
        late += behind
        a, b = rnd.randrange(5), rnd.randrange(2)
        rows.append((seq, ts - rnd.uniform(1, 60) if behind else ts, f"10.0.0.{a}", "1.1.1.1", 4000, 80 + b, 6, 40 + seq % 7, 0))
    df = spark.createDataFrame(rows, "seq long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, length int, tcp_flags int")
    query = live_flows.follow(stream(spark, tmp_path, df, "seq", parts=3), str(tmp_path / "flows"), str(tmp_path / "check"), 15.0, 120.0)
    query.awaitTermination(600)
    assert query.exception() is None and late > 30
    shown = lambda df: sorted((r["flow_id"], r["start_time"], r["end_time"], r["total_packets"], r["total_bytes"]) for r in df.collect())
    got, want = shown(live_flows.flows(spark, str(tmp_path / "flows"))), shown(fl.build_by_clock(df, 15.0, 120.0))
    assert got == want and sum(f[3] for f in got) == len(rows)


def test_flow_states(spark, tmp_path):
    at = [(1, 0.0, 80), (2, 5.0, 80), (3, 30.0, 80), (4, 31.0, 81), (5, 400.0, 82), (6, 405.0, 82), (7, 700.0, 82), (8, 2000.0, 83)]
    times = [(100, 1000.0 + 10 * i, 84) for i in range(32)]  # one flow that reaches the active limit
    # Times at or before 1970 are behind every watermark, so all are moved by BASE.
    rows = [(n, BASE + t, "a", "b", 1, p, 6, 10, 16) for n, t, p in [*at[:7], *[(100 + i, t, p) for i, (_, t, p) in enumerate(times)], at[7]]]
    df = spark.createDataFrame(rows, "seq long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, length int, tcp_flags int")
    got = drained(spark, tmp_path, live_flows.build(stream(spark, tmp_path, df, "ts")))
    flows = {(r["dst_port"], r["start_time"] - BASE, r["end_time"] - BASE, r["state"], r["total_packets"]) for r in got.collect()}
    assert {(80, 0.0, 5.0, "expired_idle", 2), (80, 30.0, 30.0, "expired_idle", 1), (81, 31.0, 31.0, "expired_idle", 1), (82, 400.0, 405.0, "expired_idle", 2), (84, 1000.0, 1300.0, "expired_active", 31)} <= flows
    assert all(p != 83 for p, *_ in flows)  # still open


def test_minutes(spark, tmp_path):
    df = spark.createDataFrame([("ddos", BASE + t) for t in (0.0, 59.0, 60.0, 1000.0)], "threat_class string, ts double")
    got = drained(spark, tmp_path, live.per_minute(stream(spark, tmp_path, df, "ts")))
    assert {(r["minute"] - BASE, r["n"]) for r in got.collect()} >= {(0, 2), (60, 1)}


def test_templates_outlive_their_batch(spark, tmp_path):
    import os

    from flowloom.sources import netflow
    from flowloom.streaming import exports
    from tests.test_sources import FIELDS, RECORD, template, v9

    sent = [v9([(256, RECORD)]), v9([(0, template(256, FIELDS)), (256, RECORD * 2)]), v9([(256, RECORD)], source=101), v9([(256, RECORD)]), b"junk", v9([(0, template(256, [(1, 8)])), (256, b"\0" * 7 + b"\5")])]
    (tmp_path / "in").mkdir()
    for i, data in enumerate(sent):
        (tmp_path / "in" / f"d{i:06}.bin").write_bytes(data)
        os.utime(tmp_path / "in" / f"d{i:06}.bin", (1e9 + i * 60, 1e9 + i * 60))
    got = drained(spark, tmp_path, exports.records(exports.datagrams(spark, str(tmp_path / "in"), 1)))
    batch = netflow.records(spark.createDataFrame(list(enumerate(sent)), "seq long, data binary"))
    rows = lambda df: sorted((r["seq"], r["pos"], r["record"], sorted(r["values"].items())) for r in df.collect())
    assert rows(got) == rows(batch) and [r[0] for r in rows(got)] == [1, 1, 3, 5]


def test_moving_mean_equals_its_recurrence(spark, tmp_path):
    from flowloom.streaming import exports

    rows = spark.createDataFrame([(i, "ab"[i % 2], float(i * i % 7)) for i in range(12)], "seq long, k string, v double")
    got = {r["seq"]: r["ewma"] for r in drained(spark, tmp_path, exports.ewma(stream(spark, tmp_path, rows, "seq"), "k", "seq", "v")).collect()}
    mean, want = {}, {}
    for r in rows.orderBy("seq").collect():
        mean[r["k"]] = r["v"] if r["k"] not in mean else 0.3 * r["v"] + 0.7 * mean[r["k"]]
        want[r["seq"]] = mean[r["k"]]
    assert got == pytest.approx(want)
