"""Queries on detectors, models, alerts and their stores, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.fixtures import view
from flowloom.functions import isolation, net, ngram, trees
from flowloom.operators import alerts as al
from flowloom.operators import detectors as det
from flowloom.operators import features as feat
from flowloom.operators import models, selection
from flowloom.plans import alert_queries as aq
from flowloom.plans.catalog import _ALERTS, _NAMES, _RECON, NOW, _gram_sql, _severe, _with, query, rounded

_DDOS = """g AS (SELECT dst_ip, greatest(max(start_time + duration) - min(start_time), 1e-9) AS span, sum(packets_fwd + packets_bwd) / span AS pps, sum(bytes_fwd + bytes_bwd) / span AS bps, count(DISTINCT src_ip) AS u, entropy(src_ip) AS e FROM flows GROUP BY dst_ip),
  rules AS (SELECT dst_ip, least(1.0, CASE WHEN pps >= 0.0001 THEN least(0.4 * pps / 0.0001 / 2, 0.4) ELSE 0 END + CASE WHEN bps >= 1 THEN least(0.3 * bps / 1 / 2, 0.3) ELSE 0 END + CASE WHEN e >= 4 AND u >= 20 THEN 0.25 ELSE 0 END) AS rule FROM g)"""


@query(f"""{_with('flows')}, {_DDOS} SELECT dst_ip, round(rule, 4)::DOUBLE AS confidence FROM rules""")
def d_ddos(spark, sf_dir):
    """Rules with limits that fit the slow fixture."""
    return det.ddos(feat.ddos(view(spark, sf_dir, "flows"), ["dst_ip"]), pps=0.0001, bps=1.0).select("dst_ip", "confidence")


@query(f"""{_with('flows')}, r AS (SELECT seq, (seq % 100) / 50.0 AS per, (seq % 7) / 5.0 AS cv, seq % 4 AS mean, 1 + seq % 2 AS card, (seq % 3) / 10.0 AS bcv, (seq % 11) / 10.0 AS p FROM flows),
  b AS (SELECT *, CASE WHEN per >= 0.5 THEN 0.2 ELSE 0 END + CASE WHEN cv <= 0.15 AND mean >= 1 THEN 0.2 ELSE 0 END + CASE WHEN card = 1 AND (per >= 0.4 OR cv <= 0.2) THEN 0.1 ELSE 0 END + CASE WHEN bcv <= 0.1 AND (per >= 0.4 OR cv <= 0.2) THEN 0.1 ELSE 0 END AS boost FROM r),
  f AS (SELECT *, greatest(p, 0.7 * p + 0.3 * boost) AS fused FROM b) SELECT seq, round(greatest(0, least(1, CASE WHEN per < 0.15 AND cv > 0.5 THEN least(fused, 0.25) ELSE fused END))::DOUBLE, 4) AS confidence FROM f""")
def d_beacon(spark, sf_dir):
    """Fusion of given probabilities and features over their whole ranges."""
    s = F.col("seq")
    rows = view(spark, sf_dir, "flows").select("seq", ((s % 100) / 50).alias("periodicity_score"), ((s % 7) / 5).alias("iat_cv"), (s % 4).alias("iat_mean"), (1 + s % 2).alias("dst_cardinality"), ((s % 3) / 10).alias("byte_size_cv"), ((s % 11) / 10).alias("p"))
    return det.beacon(rows, F.col("p")).select("seq", "confidence")


@query(f"""{_with('flows')}, r AS (SELECT seq, (seq % 50) / 10.0 AS e, -18 + (seq % 9) AS g, (seq % 6) / 10.0 AS digits, (seq % 5) / 5.0 AS txt, seq % 14 AS subs, (seq % 11) / 10.0 AS p FROM flows),
  f AS (SELECT *, greatest(p, 0.6 * p + 0.4 * (CASE WHEN e >= 3.2 THEN 0.25 ELSE 0 END + CASE WHEN g <= -16 THEN 0.25 ELSE 0 END + CASE WHEN digits >= 0.3 THEN 0.2 ELSE 0 END + CASE WHEN txt >= 0.5 THEN 0.35 ELSE 0 END + CASE WHEN subs >= 10 THEN 0.35 ELSE 0 END)) AS fused FROM r)
  SELECT seq, round(least(1, CASE WHEN e < 2.5 AND g > -14 AND txt = 0 AND subs < 2 THEN least(fused, 0.2) ELSE fused END)::DOUBLE, 4) AS confidence FROM f""")
def d_dns(spark, sf_dir):
    """Fusion of given probabilities and means over their whole ranges."""
    s = F.col("seq")
    rows = view(spark, sf_dir, "flows").select("seq", ((s % 50) / 10).alias("mean_entropy"), (-18 + s % 9).alias("mean_ngram_score"), ((s % 6) / 10).alias("mean_digit_ratio"), ((s % 5) / 5).alias("txt_null_ratio"), (s % 14).alias("unique_subdomains_per_apex"), ((s % 11) / 10).alias("p"))
    return det.dns(det.name_vector(rows), F.col("p")).select("seq", "confidence")


@query(f"""{_with('flows')}, r AS (SELECT seq, seq % 5 AS c, seq % 3 AS x, (seq % 2) * 100 AS size, seq % 13 = 0 AS bad, (seq % 21 - 10) / 20.0 AS d FROM flows),
  k AS (SELECT *, greatest(CASE WHEN bad THEN 0.98 ELSE 0 END, CASE WHEN c > 0 AND c <= 2 AND x <= 1 THEN 0.7 ELSE 0 END) AS rule FROM r)
  SELECT seq, round((CASE WHEN c > 0 OR size > 0 THEN CASE WHEN d < 0 THEN greatest(rule, least(0.85, 0.45 + 1.5 * abs(d))) WHEN rule = 0 THEN greatest(0, 0.1 - 0.4 * d) ELSE rule END ELSE rule END)::DOUBLE, 4) AS confidence FROM k""")
def d_handshake(spark, sf_dir):
    """Rules and given decisions over their whole ranges."""
    s = F.col("seq")
    rows = view(spark, sf_dir, "flows").select("seq", (s % 5).alias("cipher_suite_count"), (s % 3).alias("extension_count"), ((s % 2) * 100).alias("pkt_size_mean"), F.when(s % 13 == 0, "x").otherwise("").alias("denylist_match"), ((s % 21 - 10) / 20).alias("d"))
    return det.handshake(rows, F.col("d")).select("seq", "confidence")


@query(f"""{_with('flows').replace('WITH', 'WITH RECURSIVE', 1)}, g AS (SELECT dst_ip, greatest(max(start_time + duration) - min(start_time), 1e-9) AS span, sum(packets_fwd + packets_bwd) / span AS packets_per_sec, sum(bytes_fwd + bytes_bwd) / span AS bytes_per_sec, count(DISTINCT src_ip) AS u, u / span AS unique_src_per_sec, entropy(src_ip) AS src_ip_entropy FROM flows GROUP BY dst_ip),
  m AS (SELECT dst_ip, max(n) / sum(n) AS protocol_mix_ratio FROM (SELECT dst_ip, protocol, count(*) AS n FROM flows GROUP BY ALL) GROUP BY dst_ip), judged AS (SELECT *, 1.0 AS syn_ack_ratio, 0 AS half_open_count FROM g JOIN m USING (dst_ip)),
  {models.traffic_forest().sql("judged", "dst_ip", "decision")},
  ruled AS (SELECT dst_ip, decision AS d, round(least(1, CASE WHEN packets_per_sec >= 500 THEN least(0.4 * packets_per_sec / 1000, 0.4) ELSE 0 END + CASE WHEN bytes_per_sec >= 1e6 THEN least(0.3 * bytes_per_sec / 2e6, 0.3) ELSE 0 END + CASE WHEN src_ip_entropy >= 4 AND u >= 20 THEN 0.25 ELSE 0 END), 4) AS rule FROM judged JOIN forest_scores USING (dst_ip)),
  odds AS (SELECT *, CASE WHEN d >= 0 THEN greatest(0, 0.1 - 0.5 * d) WHEN d >= -0.08 THEN 0.1 + abs(d) / 0.08 * 0.15 ELSE least(0.95, 0.5 + 1.5 * abs(d)) END AS odd FROM ruled)
  SELECT dst_ip, round(d, 4)::DOUBLE AS decision, round((CASE WHEN rule > 0 THEN greatest(rule, 0.7 * rule + 0.3 * odd) WHEN odd < 0.5 THEN least(0.2, odd) ELSE odd END)::DOUBLE, 4) AS confidence FROM odds""")
def d_ddos_forest(spark, sf_dir):
    """Rules fused with an isolation forest fitted on harmless traffic."""
    rows = feat.ddos(view(spark, sf_dir, "flows"), ["dst_ip"]).withColumns({"syn_ack_ratio": F.lit(1.0), "half_open_count": F.lit(0)})
    return det.fused_ddos(isolation.with_decision(rows, models.traffic_forest()), F.col("decision")).select("dst_ip", F.round("decision", 4).alias("decision"), "confidence")


_BEACON = """gapped AS (SELECT *, start_time - lag(start_time) OVER (PARTITION BY src_ip ORDER BY start_time, seq) AS gap, (bytes_fwd + bytes_bwd)::DOUBLE AS size FROM flows),
  calls AS (SELECT src_ip, coalesce(avg(gap), 0) AS iat_mean, CASE WHEN coalesce(abs(avg(gap)), 0) < 1e-12 THEN 0 ELSE stddev_pop(gap) / abs(avg(gap)) END AS iat_cv, count(DISTINCT dst_ip) AS dst_cardinality,
   CASE WHEN abs(avg(duration)) < 1e-12 THEN 0 ELSE stddev_pop(duration) / avg(duration) END AS session_duration_cv, CASE WHEN abs(avg(size)) < 1e-12 THEN 0 ELSE stddev_pop(size) / avg(size) END AS byte_size_cv, min(start_time) AS t0, max(start_time) AS t1, count(*) AS n FROM gapped GROUP BY src_ip),
  bins AS (SELECT src_ip, least(floor((start_time - t0) / ((t1 - t0) / 256)), 255) AS b, count(*) AS n FROM flows JOIN calls USING (src_ip) WHERE calls.n >= 4 AND t1 - t0 >= 1e-9 GROUP BY ALL),
  power AS (SELECT src_ip, k, pow(sum(c.n * cos(k * b * (-2 * pi() / 256))), 2) + pow(sum(c.n * sin(k * b * (-2 * pi() / 256))), 2) AS p FROM bins c, range(1, 129) t(k) GROUP BY src_ip, k),
  contacts AS (SELECT c.*, coalesce(s, 0) AS periodicity_score FROM calls c LEFT JOIN (SELECT src_ip, max(p) / sum(p) AS s FROM power GROUP BY src_ip) USING (src_ip))"""
_BEACON_FUSED = """boosts AS (SELECT *, CASE WHEN periodicity_score >= 0.5 THEN 0.2 ELSE 0 END + CASE WHEN iat_cv <= 0.15 AND iat_mean >= 1 THEN 0.2 ELSE 0 END + CASE WHEN dst_cardinality = 1 AND (periodicity_score >= 0.4 OR iat_cv <= 0.2) THEN 0.1 ELSE 0 END + CASE WHEN byte_size_cv <= 0.1 AND (periodicity_score >= 0.4 OR iat_cv <= 0.2) THEN 0.1 ELSE 0 END AS boost
   FROM contacts JOIN forest_scores USING (src_ip)), fusions AS (SELECT *, greatest(probability, 0.7 * probability + 0.3 * boost) AS fused FROM boosts)"""


@query(f"""{_with('flows').replace('WITH', 'WITH RECURSIVE', 1)}, {_BEACON}, {models.beacon_forest().sql("contacts", "src_ip", "probability")}, {_BEACON_FUSED}
  SELECT src_ip, round(probability, 4)::DOUBLE AS probability, round(greatest(0, least(1, CASE WHEN periodicity_score < 0.15 AND iat_cv > 0.5 THEN least(fused, 0.25) ELSE fused END))::DOUBLE, 4) AS confidence FROM fusions""")
def d_beacon_forest(spark, sf_dir):
    """A forest on reference contacts, its share of votes fused with the rules, per source."""
    flows = view(spark, sf_dir, "flows")
    rows = feat.beacon(flows, ["src_ip"]).join(feat.periodicity(flows, ["src_ip"]), "src_ip")
    return det.beacon(trees.with_result(rows, models.beacon_forest(), "probability"), F.col("probability")).select("src_ip", F.round("probability", 4).alias("probability"), "confidence")


def _names(rows, fitted):
    for n, name in ((2, "bi"), (3, "tri")):
        rows = ngram.likelihood(rows, "label", fitted[n], name)
    label = F.col("label")
    return rows.withColumns({
        "entropy": net.entropy_of_text(label), "ngram_score": ngram.combined(F.col("bi"), F.col("tri")), "digit_ratio": net.ratio_of(label, "0-9"),
        "consonant_ratio": net.ratio_of(label, "b-df-hj-np-tv-z"), "label_length": F.length(label).cast("double"),
    })


_WORDS = " ".join(sorted(models.KNOWN_WORDS))


@query(f"""{_with('dns_queries').replace('WITH', 'WITH RECURSIVE', 1)}, {_NAMES}, corpus AS (SELECT '{_WORDS}' AS text), {_gram_sql(1)}, {_gram_sql(2)}, {_gram_sql(3)},
  judged AS (SELECT DISTINCT label, coalesce(entropy, 0) AS entropy, 0.4 * coalesce(s2.score, 0) + 0.6 * coalesce(s3.score, 0) AS ngram_score, length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label) AS digit_ratio,
   length(regexp_replace(label, '[^b-df-hj-np-tv-z]', '', 'g')) / length(label) AS consonant_ratio, length(label) AS label_length FROM labelled LEFT JOIN ent USING (label) LEFT JOIN s2 USING (label) LEFT JOIN s3 USING (label)),
  {models.name_forest().sql("judged", "label", "probability")},
  f AS (SELECT *, greatest(probability, 0.6 * probability + 0.4 * (CASE WHEN entropy >= 3.2 THEN 0.25 ELSE 0 END + CASE WHEN ngram_score <= -16 THEN 0.25 ELSE 0 END + CASE WHEN digit_ratio >= 0.3 THEN 0.2 ELSE 0 END)) AS fused FROM judged JOIN forest_scores USING (label))
  SELECT seq, label, round(probability, 4)::DOUBLE AS probability, round(least(1, CASE WHEN entropy < 2.5 AND ngram_score > -14 THEN least(fused, 0.2) ELSE fused END)::DOUBLE, 4) AS confidence FROM labelled JOIN f USING (label)""")
def d_dns_forest(spark, sf_dir):
    """A forest on frequent words and generated names, over each question's label (the form for single names)."""
    text = spark.range(1).select(F.lit(_WORDS).alias("text"))  # a fixed list
    fitted = {n: ngram.fit(text, "text", n) for n in (2, 3)}
    rows = _names(view(spark, sf_dir, "dns_queries").select("seq", net.label_of(F.col("qname")).alias("label")), fitted)
    return det.dns(trees.with_result(rows, models.name_forest(), "probability"), F.col("probability")).select("seq", "label", F.round("probability", 4).alias("probability"), "confidence")


@query(f"""{_with('flows')}, s AS (SELECT seq, src_ip, (seq % 10) / 10.0 AS a, (seq % 9) / 10.0 AS b, (seq % 8) / 10.0 AS c FROM flows)
  SELECT * FROM (SELECT seq, src_ip, 'ddos' AS threat_class, a::DOUBLE AS confidence FROM s UNION ALL SELECT seq, src_ip, 'c2_beacon', b::DOUBLE FROM s UNION ALL SELECT seq, src_ip, 'recon_scan', c::DOUBLE FROM s) WHERE confidence >= 0.25""")
def d_candidates(spark, sf_dir):
    s = F.col("seq")
    rows = view(spark, sf_dir, "flows").select("seq", "src_ip", ((s % 10) / 10).alias("ddos"), ((s % 9) / 10).alias("c2_beacon"), ((s % 8) / 10).alias("recon_scan"))
    return al.fan_out(rows, ["seq", "src_ip"]).drop("rank")


_TRIGGERS = (("%.0f ports on one target", "unique_dst_ports >= 15", "unique_dst_ports::DOUBLE"), ("%.0f hosts", "unique_dst_hosts >= 10", "unique_dst_hosts::DOUBLE"), ("%.1f flows a second", "scan_rate >= 5", "scan_rate"), ("%.1f percent unanswered", "syn_no_completion_ratio >= 0.7", "100 * syn_no_completion_ratio"), ("%.1f percent of ports in a row", "port_sequence_score >= 0.5", "100 * port_sequence_score"))


@query(f"""{_with('flows')}, {_RECON} SELECT src_ip, concat_ws('; ', {", ".join(f"CASE WHEN {c} THEN printf('{t}', {v}) END" for t, c, v in _TRIGGERS)}) AS triggers FROM recon""")
def d_evidence(spark, sf_dir):
    """Every source with all its triggers."""
    rows = feat.recon(view(spark, sf_dir, "flows"), ["src_ip"])
    return rows.select("src_ip", F.array_join(det.recon_evidence()["triggers"], "; ").alias("triggers"))


@query(f"""{_with('alerts')} SELECT 'alert-' || substr(sha256(src_ip || '|' || dst_ip || '|' || lower(threat_class) || '|' || flow_id || '|' || round(t * 1e6)::BIGINT), 1, 12) AS alert_id, t AS ts, 0::INT AS src_port, 'NEW' AS status FROM (SELECT *, CASE WHEN confidence >= 0.5 THEN ts ELSE {NOW} END AS t FROM alerts)""")
def p_alert_defaults(spark, sf_dir):
    rows = view(spark, sf_dir, "alerts").drop("alert_id").withColumn("ts", F.when(F.col("confidence") >= 0.5, F.col("ts")).otherwise(0.0))
    return al.completed(rows, NOW).select("alert_id", "ts", "src_port", "status")


@query(f"""{_with('flows')} SELECT seq, CASE WHEN packets_fwd > 7 OR packets_bwd > 2 THEN 1 ELSE 0 END AS priority FROM flows""")
def p_priority(spark, sf_dir):
    rows = view(spark, sf_dir, "flows").select("seq", (F.col("packets_fwd") * 26).alias("packets_per_sec"), (F.col("packets_bwd") * 5).alias("scan_rate"))
    return rows.select("seq", al.priority().alias("priority"))


@query(f"{_ALERTS} SELECT alert_id, threat_class, severity, confidence, src_ip, dst_ip FROM severe")
def s_alert_dump(spark, sf_dir):
    return _severe(spark, sf_dir).select("alert_id", "threat_class", "severity", "confidence", "src_ip", "dst_ip")


@query(f"""{_ALERTS} SELECT alert_id, strftime(make_timestamp((ts * 1000000)::BIGINT), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS timestamp, threat_class, severity, confidence, src_ip, dst_ip FROM severe ORDER BY ts DESC, alert_id LIMIT 1000""")
def q_export(spark, sf_dir):
    return aq.export(_severe(spark, sf_dir)).select("alert_id", "timestamp", "threat_class", "severity", "confidence", "src_ip", "dst_ip")


@query(f"""{_with('alerts', 'flows')}, a AS (SELECT count(*) FILTER (ts >= {NOW} - 10) AS a10, count(*) FILTER (ts >= {NOW} - 60) AS a60, count(*) AS n, greatest(max(ts) - min(ts), 1) AS span FROM alerts),
  f AS (SELECT coalesce(sum(bytes_fwd + bytes_bwd) FILTER (start_time + duration >= {NOW} - 10), 0) AS b10, coalesce(sum(bytes_fwd + bytes_bwd) FILTER (start_time + duration >= {NOW} - 60), 0) AS b60, sum(bytes_fwd + bytes_bwd) AS b, greatest(max(start_time + duration) - min(start_time + duration), 1) AS span FROM flows)
  SELECT (CASE WHEN a10 > 0 THEN a10 * 6 WHEN a60 > 0 THEN a60 ELSE round(n / (a.span / 60)) END)::DOUBLE AS alerts_per_minute, round(CASE WHEN b10 > 0 THEN b10 * 8 / 1e7 WHEN b60 > 0 THEN b60 * 8 / 6e7 ELSE b * 8 / 1e6 / f.span END, 6) AS mbps FROM a, f""")
def q_kpi(spark, sf_dir):
    return aq.kpi(view(spark, sf_dir, "alerts"), view(spark, sf_dir, "flows"), NOW)


_DETECTORS = "(VALUES " + ", ".join(f"('{c}', '{n}')" for c, n in aq.DETECTORS) + ") d(threat_class, name)"


@query(f"""SELECT d.threat_class, d.name, coalesce(v, '1.0.0') AS version, coalesce(p, 0.98)::DOUBLE AS precision, coalesce(r, 0.96)::DOUBLE AS recall, coalesce(f, 0.97)::DOUBLE AS f1 FROM {_DETECTORS} LEFT JOIN (VALUES ('ddos', '2.0', 0.5, 0.6, NULL)) e(threat_class, v, p, r, f) USING (threat_class)""")
def q_models(spark, sf_dir):
    return aq.models(spark.createDataFrame([("ddos", "2.0", 0.5, 0.6, None)], "threat_class string, model_version string, precision double, recall double, f1 double"))


_CHANGES = "c AS (SELECT 'alert-' || conv_id AS alert_id, turn, CASE WHEN turn % 2 = 0 THEN 'triaged' ELSE 'closed' END AS status, text AS notes FROM conversations)"


def _changes(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    status = F.when(F.col("turn") % 2 == 0, "triaged").otherwise("closed")
    return turns.select(F.concat(F.lit("alert-"), F.col("conv_id").cast("string")).alias("alert_id"), F.col("turn").alias("seq"), status.alias("status"), F.col("text").alias("notes"), F.lit(None).cast("string").alias("label"))


@query(f"""{_with('alerts')}, {_CHANGES}, l AS (SELECT alert_id, upper(arg_max(status, turn)) AS s FROM c GROUP BY alert_id) SELECT alert_id, coalesce(s, 'NEW') AS status FROM alerts LEFT JOIN l USING (alert_id)""")
def q_patched(spark, sf_dir):
    return aq.patched(view(spark, sf_dir, "alerts").select("alert_id", F.lit("NEW").alias("status")), _changes(spark, sf_dir))


@query(f"""{_with('alerts')}, {_CHANGES}, n AS (SELECT alert_id, count(*) AS n, md5(string_agg(notes, '|' ORDER BY turn, notes)) AS digest FROM c WHERE notes IS NOT NULL GROUP BY alert_id) SELECT alert_id, n, digest FROM alerts LEFT JOIN n USING (alert_id)""")
def q_annotations(spark, sf_dir):
    rows = aq.with_annotations(view(spark, sf_dir, "alerts").select("alert_id"), aq.annotations(_changes(spark, sf_dir)))
    a = F.col("annotations")
    return rows.select("alert_id", F.when(a.isNotNull(), F.size(a)).cast("long").alias("n"), F.md5(F.array_join(a["notes"], "|")).alias("digest"))


@query(f"""{_ALERTS} SELECT (floor(ts / 86400) * 86400)::BIGINT AS bucket, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity IN ('MEDIUM', 'LOW')) AS other FROM severe GROUP BY 1""")
def q_shown_classes(spark, sf_dir):
    return aq.shown_classes(aq.trends(_severe(spark, sf_dir), 86_400))


@query(f"""{_with('flows')} SELECT seq, 'a' AS label, bytes_fwd, 0.0::DOUBLE AS extra FROM flows WHERE seq % 2 = 0 UNION ALL SELECT seq, 'b', bytes_fwd, duration FROM flows WHERE seq % 2 = 1""")
def m_union_filled(spark, sf_dir):
    """Captures with unlike columns united, what is missing filled with 0."""
    flows = view(spark, sf_dir, "flows")
    a = flows.where("seq % 2 = 0").select("seq", F.lit("a").alias("label"), "bytes_fwd")
    b = flows.where("seq % 2 = 1").select("seq", F.lit("b").alias("label"), "bytes_fwd", F.col("duration").alias("extra"))
    return a.unionByName(b, allowMissingColumns=True).fillna(0.0, ["extra"])


@query(f"""{_with('packets', 'flows')} SELECT round(sum(length) * 8 / 1e6 / (max(ts) - min(ts)), 9) AS mbps, round(count(*) / (max(ts) - min(ts)), 9) AS packets_per_second, (SELECT median(duration) * 1000 <= 5000 FROM flows) AS complies FROM packets""")
def b_throughput(spark, sf_dir):
    span = F.max("ts") - F.min("ts")
    rates = view(spark, sf_dir, "packets").agg(F.round(F.sum("length") * 8 / 1e6 / span, 9).alias("mbps"), F.round(F.count("*") / span, 9).alias("packets_per_second"))
    (median,) = selection.quantiles(view(spark, sf_dir, "flows"), "duration", [0.5])
    return rates.withColumn("complies", F.lit(median).cast("double") * 1000 <= 5000)
