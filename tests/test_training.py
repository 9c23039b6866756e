"""Forests on held-out sessions, model cards, generated traffic end to end, and sensors."""

import pytest
from pyspark.sql import functions as F

from flowloom.functions import shown
from flowloom.operators import features, flows, models, training
from flowloom.plans import alert_queries
from flowloom.sources import generated


def test_rates_that_cannot_be_read(spark):
    rows = spark.createDataFrame([("10",), (" 5.5 Mb/s ",), ("1e2mbit",), ("",), ("x10",), (None,)], "t string")
    assert [r[0] for r in rows.select(shown.rate_mbps(F.col("t"))).collect()] == [10.0, 5.5, 100.0, None, None, None]


def test_shown_times_without_a_time(spark):
    row = spark.createDataFrame([(0.0, None)], "a double, b double").select(shown.time_text(F.col("a")), shown.age_text(F.col("b"), F.lit(9.0)), shown.severity_text(F.lit("")), shown.severity_style(F.lit(None).cast("string"))).first()
    assert tuple(row) == ("—", "—", "LOW", "chip-low")


def test_forest_on_other_sessions(spark):
    train, test = models.contacts(spark, 150, 1), models.contacts(spark, 60, 7)
    named = lambda df: df.withColumn("label", F.when(F.col("label") == 1, "c2_beacon").otherwise("benign"))
    model = training.fit(named(train), "c2_beacon", list(models.IRREGULAR))
    assert model.stages[1].getNumTrees == 50
    measured = training.evaluate(model, named(test), "c2_beacon").first().asDict()
    assert measured["tp"] + measured["fn"] == 60 and measured["f1"] > 0.95
    card = training.card("beacon", "random forest", "c2_beacon", measured, 300, 120)
    assert f"`{measured['f1']:.4f}`" in card and "| Rows for training | 300 |" in card


def test_metrics_without_rows(spark):
    row = training.metrics(spark.createDataFrame([], "y int, p int"), "y", "p").first()
    assert (row["tp"], row["precision"], row["f1"]) == (0, 0.0, 0.0)


def test_training_rows_of_generated_traffic(spark):
    packets = generated.packets(spark, 600).withColumn("dns_qtype", F.when(F.col("dns_qname").isNotNull(), "A"))
    assert {r["label"]: r["count"] for r in packets.groupBy("label").count().collect()} == {k["label"].strip("'"): 100 for k in generated.ATTACKS}
    built = flows.build(packets, 15.0)
    rows = training.rows(built, packets, "mix", "dga_dns")
    assert rows.count() == built.count() and len(set(rows.columns)) == len(rows.columns)
    asked = rows.where("dns_unique_qnames IS NOT NULL").agg(F.max("dns_unique_qnames"), F.min("exfil_destination_novel")).first()
    assert tuple(asked) == (100, 1)
    assert training.rows(built, packets, "mix", "benign").agg(F.max("is_attack")).first()[0] == 0


def test_harmless_traffic_has_no_scan(spark):
    rows = features.recon(flows.build(generated.packets(spark, 300, generated.HARMLESS, gap=0.05), 15.0), ["src_ip"])
    assert rows.agg(F.max("unique_dst_ports")).first()[0] <= 3


def test_exfiltration_against_nothing_and_a_flat_baseline(spark):
    rows = spark.createDataFrame([(1, "s", "d", 99, 0, 1.0, 1.0), (2, "t", "d", 5, 5, 1.0, 0.0)], "seq long, src_ip string, dst_ip string, bytes_fwd long, bytes_bwd long, duration double, start_time double")
    bare = features.exfiltration_against(rows, ["seq"]).orderBy("seq").collect()
    assert [r["outbound_volume_zscore"] for r in bare] == [0.0, 0.0] and [r["destination_novel"] for r in bare] == [1, 1]
    known = spark.createDataFrame([("s", 10), ("s", 10), ("t", 1)], "src_ip string, bytes_fwd long")
    seen = spark.createDataFrame([("s", "d"), ("s", "d")], "src_ip string, dst_ip string")
    got = features.exfiltration_against(rows, ["seq"], known, seen).orderBy("seq").collect()
    assert [(r["outbound_volume_zscore"], r["destination_novel"]) for r in got] == [(float("inf"), 0), (0.0, 1)]


def test_stored_sensors_replace_the_standing_one(spark):
    stored = spark.createDataFrame([("a", "n", "eth0", "1.1.1.1", "ACTIVE", 1_700_000_000.5)], alert_queries.SENSORS)
    rows = alert_queries.sensors(stored).collect()
    assert len(rows) == 1 and rows[0]["last_heartbeat"] == "2023-11-14T22:13:20.500000+00:00"


def test_health_of_a_lost_store(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert alert_queries.health(stored, 1.0, 2.0).first()["status"] == "ok"
    for f in (tmp_path / "t").glob("*.parquet"):
        f.rename(f.with_suffix(".gone"))
    row = alert_queries.health(stored, 1.0, 2.0).first()
    assert (row["status"], row["db_connected"]) == ("degraded", False)


@pytest.mark.parametrize("kinds", [generated.ATTACKS, generated.HARMLESS])
def test_generated_rows_follow_from_their_number(spark, kinds):
    few, many = generated.packets(spark, 30, kinds), generated.packets(spark, 90, kinds)
    assert few.exceptAll(many).count() == 0 and generated.packets(spark, 0, kinds).count() == 0


def test_split_keeps_sessions_whole(spark):
    rows = spark.createDataFrame([(f"s{i % 7}", "ddos", i, 1.0) for i in range(70)] + [(f"b{i % 3}", "benign", i, 1.0) for i in range(30)] + [("one", "recon_scan", i, 1.0) for i in range(400)], "session_id string, label string, n long, f double")
    got = training.split(rows).collect()
    parts = {}
    for r in got:
        parts.setdefault((r["label"], r["session_id"]), set()).add(r["part"])
    assert all(len(p) == 1 for (label, _), p in parts.items() if label == "ddos")
    count = lambda label, part: sum(1 for (lab, _), p in parts.items() if lab == label and part in p)
    assert [count("ddos", p) for p in ("train", "validation", "test")] == [4, 1, 2]
    assert [count("benign", p) for p in ("train", "validation", "test")] == [2, 1, 1]  # the session of validation serves for both
    alone = [r["part"] for r in got if r["label"] == "recon_scan"]
    assert len(alone) == 400 and 240 < alone.count("train") < 320 and {*alone} == {"train", "validation", "test"}


def test_rows_take_gaps_from_packets_and_are_saved(spark, tmp_path):
    from flowloom.operators import flows as fl

    packets = spark.createDataFrame([(i, 30.0 * i, "a", "b", 1, 2, 6, 100, 16, None) for i in range(20)], "seq long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, length int, tcp_flags int, tls_raw binary")
    rows = training.rows(fl.build(packets, 1000.0), packets, "cap", "c2_beacon")
    r = rows.first()
    assert (r["c2_iat_mean"], r["c2_iat_cv"], r["c2_byte_size_cv"], r["enc_cipher_suite_count"], r["enc_denylist_match"]) == (30.0, 0.0, 0.0, 0, "")
    training.save(rows, str(tmp_path / "rows"))
    back = spark.read.csv(str(tmp_path / "rows"), header=True, inferSchema=True)
    assert back.columns == rows.columns and back.first()["c2_iat_mean"] == 30.0


def test_report():
    row = {"target_mbps": 5.0, "effective_mbps": 0.5, "packets_per_sec": 60.0, "alerts": 3, "median_latency_ms": 10.0, "p95_latency_ms": 20.0, "drops": 0}
    text = training.report([row])
    assert "| 5.00 | 0.50 | 60.00 | 3 | 10.00 | 20.00 | 0 |" in text and "PASS" in text
    assert "FAIL" in training.report([row | {"drops": 1}])
