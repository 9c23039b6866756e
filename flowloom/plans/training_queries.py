"""Queries on shown columns, given baselines, training rows and generated packets, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.fixtures import view
from flowloom.functions import shown
from flowloom.operators import features as feat
from flowloom.operators import flows as fl
from flowloom.operators import training
from flowloom.plans import alert_queries as aq
from flowloom.plans.catalog import _ALERTS, _FLOWS, IDLE, NOW, _severe, _with, query, rounded
from flowloom.plans.packet_queries import _ASKS, HELLOS, with_hellos
from flowloom.sources import generated

_RATES = ("'' || (seq % 50)", "(seq % 50) || 'Mbps'", "' ' || (seq % 50) || '.5 mbit/s '", "(seq % 50) || ' MB/s'", "'fast'")


@query(f"""{_with('flows')} SELECT seq, CASE WHEN seq % 5 = 4 THEN NULL ELSE (seq % 50) + CASE WHEN seq % 5 = 2 THEN 0.5 ELSE 0 END END::DOUBLE AS mbps FROM flows""")
def p_rates(spark, sf_dir):
    text = F.expr("CASE seq % 5 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_RATES)) + " END")
    return view(spark, sf_dir, "flows").select("seq", shown.rate_mbps(text).alias("mbps"))


@query(f"""{_ALERTS} SELECT alert_id, strftime(make_timestamp((ts * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S') || ' UTC' AS at, CASE WHEN {NOW} - ts < 5 THEN 'just now' WHEN {NOW} - ts < 60 THEN floor({NOW} - ts)::BIGINT || 's ago' WHEN {NOW} - ts < 3600 THEN (floor({NOW} - ts)::BIGINT // 60) || 'm ago' ELSE (floor({NOW} - ts)::BIGINT // 3600) || 'h ago' END AS age,
  severity AS shown, 'chip-' || lower(severity) AS style, CASE WHEN ts::BIGINT % 3 = 0 THEN 'TCP (6)' WHEN ts::BIGINT % 3 = 1 THEN 'UDP (17)' ELSE '1' END AS protocol FROM severe""")
def p_shown(spark, sf_dir):
    kind = F.expr("CASE CAST(ts AS BIGINT) % 3 WHEN 0 THEN 6 WHEN 1 THEN 17 ELSE 1 END")
    s = F.col("severity")
    return _severe(spark, sf_dir).select("alert_id", shown.time_text(F.col("ts")).alias("at"), shown.age_text(F.col("ts"), F.lit(NOW)).alias("age"), shown.severity_text(s).alias("shown"), shown.severity_style(s).alias("style"), shown.protocol_text(kind).alias("protocol"))


CUT = 820_454_400.0


@query(f"""{_with('flows')}, known AS (SELECT * FROM flows WHERE start_time < {CUT}), k AS (SELECT src_ip, avg(bytes_fwd) AS m, stddev_pop(bytes_fwd) AS sd, count(*) AS n FROM known GROUP BY src_ip), p AS (SELECT DISTINCT src_ip, dst_ip FROM known)
  SELECT seq, round(CASE WHEN coalesce(n, 0) < 2 THEN 0 WHEN sd < 1e-9 THEN CASE WHEN bytes_fwd > m THEN 'inf'::DOUBLE ELSE 0 END ELSE (bytes_fwd - m) / sd END, 6) AS outbound_volume_zscore, CASE WHEN p.src_ip IS NULL THEN 1 ELSE 0 END AS destination_novel
  FROM flows f LEFT JOIN k USING (src_ip) LEFT JOIN p ON p.src_ip = f.src_ip AND p.dst_ip = f.dst_ip""")
def a_exfiltration_given(spark, sf_dir):
    """All flows against a baseline of those before a day."""
    flows = view(spark, sf_dir, "flows")
    known = flows.where(F.col("start_time") < CUT)
    return rounded(feat.exfiltration_against(flows, ["seq"], known, known).select("seq", "outbound_volume_zscore", "destination_novel"))


_PAIRS = f"""o AS (SELECT *, least(src_ip, dst_ip) AS a, greatest(src_ip, dst_ip) AS b FROM hello_packets), q AS (SELECT *, row_number() OVER w AS r, ts - lag(ts) OVER w AS gap FROM o WINDOW w AS (PARTITION BY a, b ORDER BY ts, seq)),
  g AS (SELECT a, b, count(*) AS n, coalesce(avg(gap), 0) AS iat_mean, coalesce(stddev_pop(gap), 0) AS iat_sd, stddev_pop(length) / avg(length) AS size_cv, min(ts) AS t0, max(ts) AS t1 FROM q GROUP BY a, b),
  c AS (SELECT a, b, least(floor((ts - t0) / ((t1 - t0) / 256)), 255) AS bin, count(*) AS n FROM q JOIN g USING (a, b) WHERE g.n >= 4 AND t1 - t0 >= 1e-9 GROUP BY ALL),
  w AS (SELECT a, b, k, pow(sum(c.n * cos(k * bin * (-2 * pi() / 256))), 2) + pow(sum(c.n * sin(k * bin * (-2 * pi() / 256))), 2) AS p FROM c, range(1, 129) t(k) GROUP BY a, b, k),
  per AS (SELECT a, b, max(p) / sum(p) AS score FROM w GROUP BY a, b), e AS (SELECT a, b, avg(length) AS m FROM q WHERE r <= 10 GROUP BY a, b),
  hs AS (SELECT a, b, arg_min(cipher_suite_count, (ts, seq)) AS ciphers, arg_min(ja3_hash, (ts, seq)) AS ja3_hash FROM q WHERE tls GROUP BY a, b),
  dq AS (SELECT a, b, count(DISTINCT seq % 5) AS names, avg(CASE WHEN 1 + seq % 30 IN (10, 16) THEN 1 ELSE 0 END) AS data FROM q WHERE {_ASKS} GROUP BY a, b)"""


@query(f"""{_with('packets')}, {HELLOS}, {_FLOWS}, {_PAIRS}
  SELECT flow_id, flow_no, 'events_c2_beacon' AS session_id, 'c2_beacon' AS label, 1 AS is_attack, round(total_packets / greatest(duration, 1e-9), 6) AS ddos_packets_per_sec, 1::BIGINT AS recon_unique_dst_ports,
   round(CASE WHEN n >= 2 THEN iat_mean ELSE 0 END, 3) AS c2_iat_mean, round(CASE WHEN n >= 2 AND abs(iat_mean) >= 1e-12 THEN iat_sd / abs(iat_mean) ELSE 0 END, 6) AS c2_iat_cv, round(CASE WHEN n >= 2 THEN size_cv ELSE 0 END, 6) AS c2_byte_size_cv,
   round(CASE WHEN n >= 2 THEN coalesce(score, 0) ELSE 0 END, 6) AS c2_periodicity_score, round(CASE WHEN bytes_bwd = 0 THEN 0 ELSE bytes_fwd / bytes_bwd END, 6) AS exfil_outbound_inbound_ratio, round(m, 6) AS enc_pkt_size_mean, coalesce(ciphers, 0)::INT AS enc_cipher_suite_count, coalesce(ja3_hash, '') AS enc_ja3_hash,
   CASE WHEN protocol = 6 THEN CASE WHEN packets_fwd > 0 AND packets_bwd = 0 THEN 1 ELSE 0 END ELSE 0 END::DOUBLE AS recon_syn_no_completion_ratio, names AS dns_unique_qnames, round(data, 6) AS dns_txt_null_ratio
  FROM built f JOIN g ON g.a = least(src_ip, dst_ip) AND g.b = greatest(src_ip, dst_ip) JOIN e USING (a, b) LEFT JOIN per USING (a, b) LEFT JOIN hs USING (a, b) LEFT JOIN dq USING (a, b)""")
def m_training_rows(spark, sf_dir):
    """Packet features of both hosts' packets, among them rhythm, handshakes and questions."""
    asks = lambda text: F.when(F.expr(_ASKS), F.expr(text))
    packets = with_hellos(view(spark, sf_dir, "packets")).withColumns({"dns_qname": asks("concat('host', seq % 5, '.example.com')"), "dns_qtype": asks("cast(1 + seq % 30 AS string)")})
    rows = training.rows(fl.build(packets, IDLE), packets, "events", "c2_beacon")
    rows = rows.withColumn("c2_iat_mean", F.round("c2_iat_mean", 3))
    return rounded(rows.select("flow_id", "flow_no", "session_id", "label", "is_attack", "ddos_packets_per_sec", "recon_unique_dst_ports", "c2_iat_mean", "c2_iat_cv", "c2_byte_size_cv", "c2_periodicity_score", "exfil_outbound_inbound_ratio", "enc_pkt_size_mean", "enc_cipher_suite_count", "enc_ja3_hash", "recon_syn_no_completion_ratio", "dns_unique_qnames", "dns_txt_null_ratio"))


@query(f"SELECT * REPLACE (round(ts, 6) AS ts) FROM ({generated.select_sql(generated.ATTACKS, '(SELECT unnest(range(3000)) AS i)')})")
def s_generated(spark, sf_dir):
    """Six kinds of attack in turn."""
    return rounded(generated.packets(spark, 3000))


@query(f"SELECT '{aq.SENSOR[0]}' AS id, '{aq.SENSOR[1]}' AS name, '{aq.SENSOR[2]}' AS interface, '{aq.SENSOR[3]}' AS ip_address, 'ACTIVE' AS status, NULL::VARCHAR AS last_heartbeat")
def q_sensors(spark, sf_dir):
    return aq.sensors(spark.createDataFrame([], aq.SENSORS))


@query("SELECT 'ok' AS status, 12.5::DOUBLE AS uptime_seconds, TRUE AS db_connected, 112.5::DOUBLE AS timestamp")
def q_health(spark, sf_dir):
    return aq.health(view(spark, sf_dir, "alerts"), 100.0, 112.5)


@query(f"{_with('flows')} SELECT 'flow-' || seq AS flow_id, src_ip, dst_ip, bytes_fwd FROM flows WHERE seq = 7")
def q_flow(spark, sf_dir):
    flows = view(spark, sf_dir, "flows").withColumn("flow_id", F.concat(F.lit("flow-"), F.col("seq").cast("string")))
    return aq.flow(flows, "flow-7").select("flow_id", "src_ip", "dst_ip", "bytes_fwd")
