"""Models on rows they must tell apart, and on what was stored of them."""

import numpy as np
from pyspark.sql import functions as F

from flowloom.functions import isolation, trees
from flowloom.operators import detectors, models


def test_forest_finds_outliers_and_is_stored(spark, tmp_path):
    forest = models.traffic_forest()
    forest.save(spark, str(tmp_path / "forest"))
    x = np.array([[50, 5e4, 1, 5, 1.5, 0.6, 2], [1e5, 1e8, 50, 900, 8, 1, 5000]])
    back = trees.Forest.load(spark, str(tmp_path / "forest"))
    assert back == forest
    calm, flood = -np.exp2(-back.mean(x) / back.scale) - back.offset
    assert flood < 0 < calm
    rows = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ["i", *models.CALM_TRAFFIC]).withColumn("unique_src_count", F.lit(1))
    got = detectors.fused_ddos(isolation.with_decision(rows, forest), F.col("decision")).orderBy("i").collect()
    assert np.allclose([r["decision"] for r in got], [calm, flood]) and got[0]["confidence"] <= 0.2 < got[1]["confidence"]


def test_contacts_are_told_apart_and_model_is_stored(spark, tmp_path):
    held = models.contacts(spark, 50, seed=7)
    fits = []
    make = lambda: fits.append(1) or models.fit_forest(models.contacts(spark), list(models.IRREGULAR))
    for _ in range(2):
        model = models.load_or_fit(spark, str(tmp_path / "m"), make)
        right = models.with_probability(held, model).where((F.col("probability") > 0.5) == (F.col("label") == 1)).count()
        assert right >= 98
    assert len(fits) == 1


def test_forest_scores_equal_a_plain_walk(spark):
    """The arrays walked tree by tree and row by row, for all rows of the handshake query."""
    from flowloom.functions import isolation
    from flowloom.operators import features as feat
    from flowloom.operators import models
    from flowloom.plans import packet_queries as pq

    forest = models.handshake_forest()
    packets = pq.with_hellos(pq.view(spark, "/root/testdata/sf0.001", "packets"))
    rows = isolation.with_decision(feat.encrypted(packets, ["src_ip", "dst_ip"]), forest).collect()
    assert any(r["cipher_suite_count"] > 0 for r in rows)
    for r in rows:
        depths = []
        for at in forest.roots:
            while forest.feature[at] >= 0:
                at = forest.left[at] if (r[forest.columns[forest.feature[at]]] or 0.0) < forest.limit[at] else forest.right[at]
            depths.append(forest.value[at])
        want = -(2 ** (-sum(depths) / len(depths) / forest.scale)) - forest.offset
        assert abs(r["decision"] - want) < 1e-9


def test_names_are_told_apart(spark):
    """Names and words that the model was not fitted on, each by itself (the form for single names); features equal those of columns."""
    from flowloom.functions import ngram
    from flowloom.plans import scoring

    words = "weather holiday network kitchen bicycle picture morning summer window garden market travel music doctor coffee engine silver orange library season forest bridge camera ticket pocket winter flower island museum planet station village".split()
    rows = spark.createDataFrame([(w, 0.0) for w in words] + [(w, 1.0) for w in models.random_names(300, seed=5)], "label string, class double")
    text = spark.range(1).select(F.lit(scoring._WORDS).alias("text"))
    named = scoring._names(rows, {n: ngram.fit(text, "text", n) for n in (2, 3)})
    got = trees.with_result(named, models.name_forest(), "probability").collect()
    made, known = ([r["probability"] > 0.5 for r in got if r["class"] == c] for c in (1.0, 0.0))
    assert np.mean(made) > 0.95 and np.mean(known) < 0.1
    plain = models.name_features([r["label"] for r in got])
    assert np.allclose(plain, [[r[c] for c in models.NAME_FEATURES] for r in got])


def test_contacts_by_votes(spark):
    x, y = models.contact_rows(60, seed=7)
    forest = models.beacon_forest()
    rows = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y, strict=True)], [*models.IRREGULAR, "label"])
    got = trees.with_result(rows, forest, "p").collect()
    assert np.allclose([r["p"] for r in got], forest.mean(np.array([[r[c] for c in forest.columns] for r in got])))
    assert np.mean([(r["p"] > 0.5) == (r["label"] == 1) for r in got]) > 0.97


def test_scores_round_as_sql(spark):
    """Sums of shares that end next to half of the fourth place."""
    import duckdb
    from pyspark.sql import functions as F

    from flowloom.operators import detectors as det

    steps = spark.range(5000, 12000).withColumn("r", F.col("id") / 1000)
    rows = steps.select("id", F.lit(0.0).alias("outbound_volume_zscore"), F.col("r").alias("outbound_inbound_ratio"), F.lit(1.0).alias("duration_bytes_ratio"), F.lit(1).alias("off_hours_flag"), F.lit(0).alias("destination_novel"))
    want = dict(duckdb.sql("SELECT i, round(least(0.25 * (i / 1000) / 5, 0.4) + 0.2, 4) FROM range(5000, 12000) t(i)").fetchall())
    assert {r["id"]: r["confidence"] for r in det.exfiltration(rows).collect()} == want


def test_counts_round_as_sql(spark):
    """Means next to half of the third place."""
    import duckdb
    from pyspark.sql import functions as F

    from flowloom.plans import alert_queries as aq

    given = spark.range(10_000).select(F.col("id").cast("string").alias("threat_class"), F.lit("LOW").alias("severity"), (F.col("id") / 10_000).alias("confidence"))
    want = dict(duckdb.sql("SELECT i::VARCHAR, round(avg(i / 10000), 3) FROM range(10000) t(i) GROUP BY i").fetchall())
    assert {r["threat_class"]: r["avg_confidence"] for r in aq.counts(given).where("threat_class IS NOT NULL").collect()} == want


def test_evidence_texts_and_rounding(spark):
    from pyspark.sql import functions as F

    from flowloom.functions import net
    from flowloom.operators import detectors as det

    row = spark.range(1).select(net.half_even(F.lit(0.125), 2).alias("a"), net.half_even(F.lit(0.375), 2).alias("b"), net.half_even(F.lit(-2.5), 0).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (0.12, 0.38, -2.0)
    x = spark.createDataFrame([(600.0, 10.0, 25, 4.5)], "packets_per_sec double, bytes_per_sec double, unique_src_count int, src_ip_entropy double")
    text = x.select(det.evidence_json(det.ddos_evidence())).first()[0]
    assert '"600.0 packets a second"' in text and "4.50 bits" in text and "bytes a second" not in text
    back = spark.createDataFrame([(text,), ("no object",), (None,)], "t string").select(det.evidence_parsed(F.col("t")).alias("m")).collect()
    assert back[0]["m"]["packets_per_sec"] == "600.0" and back[1]["m"] == {} and back[2]["m"] == {}
    y = spark.createDataFrame([(1, 0, "bad", 100.0, 0.1, 2, 0.05, 0.7, 1.0, 0.05, 9.0, 6.0, 0.1, 1, 1, 3.5, -17.0, 0.4, 12.0)], "cipher_suite_count int, extension_count int, denylist_match string, pkt_size_mean double, pkt_ipt_mean double, dst_cardinality int, iat_cv double, periodicity_score double, iat_mean double, byte_size_cv double, outbound_volume_zscore double, outbound_inbound_ratio double, duration_bytes_ratio double, off_hours_flag int, destination_novel int, entropy double, ngram_score double, digit_ratio double, label_length double")
    said = y.select(*(e()["triggers"] for e in (det.handshake_evidence, det.beacon_evidence, det.exfiltration_evidence, det.dns_evidence))).first()
    assert [len(t) for t in said] == [2, 3, 4, 3]
