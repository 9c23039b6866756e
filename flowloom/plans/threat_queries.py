"""From packets to alerts of all six classes, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.fixtures import view
from flowloom.functions import net, ngram
from flowloom.operators import flows as fl
from flowloom.operators import models, threats
from flowloom.plans import alert_queries as aq
from flowloom.plans.catalog import _EXFIL, _FLOWS, _NAMES, _RECON, _SEVERE, IDLE, WINDOW, _gram_sql, _with, query, rounded
from flowloom.plans.packet_queries import _ASKS, _DENIED, HELLOS, with_hellos
from flowloom.plans.scoring import _BEACON, _BEACON_FUSED, _WORDS
from flowloom.written import written

_SIX = f"""{_with('packets').replace('WITH', 'WITH RECURSIVE', 1)}, {HELLOS}, {_FLOWS}, flows AS (SELECT *, first_seq AS seq FROM built),
  dns_queries AS (SELECT seq, 'host' || seq % 5 || '.example.com' AS qname, (1 + seq % 30)::VARCHAR AS qtype, src_ip, ts FROM packets WHERE {_ASKS}),
  dd AS (SELECT dst_ip, greatest(max(start_time + duration) - min(start_time), 1e-9) AS span, sum(packets_fwd + packets_bwd) / span AS packets_per_sec, sum(bytes_fwd + bytes_bwd) / span AS bytes_per_sec, count(DISTINCT src_ip) AS u, u / span AS unique_src_per_sec, entropy(src_ip) AS src_ip_entropy FROM flows GROUP BY dst_ip),
  dm AS (SELECT dst_ip, max(n) / sum(n) AS protocol_mix_ratio FROM (SELECT dst_ip, protocol, count(*) AS n FROM flows GROUP BY ALL) GROUP BY dst_ip),
  dk AS (SELECT dst_ip, ip_a, port_a, ip_b, port_b, protocol, count(*) FILTER (tcp_flags & 2 <> 0) AS syn, count(*) FILTER (tcp_flags & 16 <> 0) AS ack, count(*) FILTER (tcp_flags & 2 <> 0 AND tcp_flags & 16 = 0) AS bare, count(*) FILTER (NOT is_forward) AS back FROM keyed GROUP BY ALL),
  dh AS (SELECT dst_ip, CASE WHEN sum(ack) = 0 THEN 0 ELSE sum(syn) / sum(ack) END AS syn_ack_ratio, greatest(sum(bare) - count(*) FILTER (protocol = 6 AND back > 0), 0) AS half_open_count FROM dk GROUP BY dst_ip),
  dj AS (SELECT * FROM dd JOIN dm USING (dst_ip) LEFT JOIN dh USING (dst_ip)), {models.traffic_forest().sql("dj", "dst_ip", "d", "dd_forest")},
  dr AS (SELECT dst_ip, d, round(least(1, CASE WHEN packets_per_sec >= 500 THEN least(0.4 * packets_per_sec / 1000, 0.4) ELSE 0 END + CASE WHEN bytes_per_sec >= 1e6 THEN least(0.3 * bytes_per_sec / 2e6, 0.3) ELSE 0 END + CASE WHEN syn_ack_ratio >= 5 THEN 0.25 ELSE 0 END
   + CASE WHEN src_ip_entropy >= 4 AND u >= 20 THEN 0.25 ELSE 0 END + CASE WHEN half_open_count >= 20 THEN 0.2 ELSE 0 END), 4) AS rule FROM dj JOIN dd_forest_scores USING (dst_ip)),
  dq AS (SELECT *, CASE WHEN d >= 0 THEN greatest(0, 0.1 - 0.5 * d) WHEN d >= -0.08 THEN 0.1 + abs(d) / 0.08 * 0.15 ELSE least(0.95, 0.5 + 1.5 * abs(d)) END AS odd FROM dr),
  floods AS (SELECT dst_ip, CASE WHEN rule > 0 THEN greatest(rule, 0.7 * rule + 0.3 * odd) WHEN odd < 0.5 THEN least(0.2, odd) ELSE odd END AS c FROM dq),
  {_BEACON}, {models.beacon_forest().sql("contacts", "src_ip", "probability")}, {_BEACON_FUSED},
  beacons AS (SELECT src_ip, greatest(0, least(1, CASE WHEN periodicity_score < 0.15 AND iat_cv > 0.5 THEN least(fused, 0.25) ELSE fused END)) AS c FROM fusions),
  {_NAMES}, corpus AS (SELECT '{_WORDS}' AS text), {_gram_sql(1)}, {_gram_sql(2)}, {_gram_sql(3)},
  subs AS (SELECT src_ip, avg(n) AS subs FROM (SELECT src_ip, apex, count(DISTINCT sub) AS n FROM labelled WHERE apex IS NOT NULL GROUP BY ALL) GROUP BY src_ip),
  nm AS (SELECT l.src_ip, avg(e.entropy) AS entropy, avg(0.4 * coalesce(s2.score, 0) + 0.6 * coalesce(s3.score, 0)) AS ngram_score, avg(length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label)) AS digit_ratio, 0.6 AS consonant_ratio, avg(length(label)) AS label_length,
   avg(CASE WHEN qtype IN ('10', '16', '255') THEN 1 ELSE 0 END) AS txt, coalesce(any_value(subs), 0) AS subs FROM labelled l LEFT JOIN ent e USING (label) LEFT JOIN s2 USING (label) LEFT JOIN s3 USING (label) LEFT JOIN subs ON subs.src_ip = l.src_ip GROUP BY l.src_ip),
  {models.name_forest().sql("nm", "src_ip", "p", "nm_forest")},
  nf AS (SELECT *, greatest(p, 0.6 * p + 0.4 * (CASE WHEN entropy >= 3.2 THEN 0.25 ELSE 0 END + CASE WHEN ngram_score <= -16 THEN 0.25 ELSE 0 END + CASE WHEN digit_ratio >= 0.3 THEN 0.2 ELSE 0 END + CASE WHEN txt >= 0.5 THEN 0.35 ELSE 0 END + CASE WHEN subs >= 10 THEN 0.35 ELSE 0 END)) AS fused FROM nm JOIN nm_forest_scores USING (src_ip)),
  names_judged AS (SELECT src_ip, least(1, CASE WHEN entropy < 2.5 AND ngram_score > -14 AND txt = 0 AND subs < 2 THEN least(fused, 0.2) ELSE fused END) AS c FROM nf),
  ho AS (SELECT *, row_number() OVER w AS r, ts - lag(ts) OVER w AS gap FROM packets WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY ts, seq)),
  hs AS (SELECT src_ip, dst_ip, avg(length) AS pkt_size_mean, stddev_pop(length) AS pkt_size_std, coalesce(avg(gap), 0) AS pkt_ipt_mean, coalesce(stddev_pop(gap), 0) AS pkt_ipt_std FROM ho WHERE r <= 10 GROUP BY ALL),
  hh AS (SELECT src_ip, dst_ip, arg_min(cipher_suite_count, (ts, seq)) AS hc, arg_min(extension_count, (ts, seq)) AS he, arg_min(ja3_string, (ts, seq)) AS ja3 FROM hello_packets WHERE tls GROUP BY ALL),
  hj AS (SELECT *, s.src_ip || '>' || s.dst_ip AS pair, coalesce(hc, 0) AS cipher_suite_count, coalesce(he, 0) AS extension_count FROM hs s LEFT JOIN hh h ON h.src_ip = s.src_ip AND h.dst_ip = s.dst_ip), {models.handshake_forest().sql("hj", "pair", "d", "hs_forest")},
  hk AS (SELECT j.*, d, greatest(CASE WHEN ja3 = '771,4865,0-10-11,29-23,0' THEN 0.98 ELSE 0 END, CASE WHEN cipher_suite_count > 0 AND cipher_suite_count <= 2 AND extension_count <= 1 THEN 0.7 ELSE 0 END) AS rule FROM hj j JOIN hs_forest_scores USING (pair)),
  hellos AS (SELECT src_ip, dst_ip, CASE WHEN cipher_suite_count > 0 OR pkt_size_mean > 0 THEN CASE WHEN d < 0 THEN greatest(rule, least(0.85, 0.45 + 1.5 * abs(d))) WHEN rule = 0 THEN greatest(0, 0.1 - 0.4 * d) ELSE rule END ELSE rule END AS c FROM hk),
  {_EXFIL}, ey AS (SELECT *, CASE WHEN isnan(outbound_volume_zscore) THEN 0 WHEN outbound_volume_zscore > 50 THEN 10 ELSE outbound_volume_zscore END AS z, outbound_inbound_ratio AS rt, duration_bytes_ratio AS dr FROM exfil),
  volumes AS (SELECT src_ip, dst_ip, max(least(1, CASE WHEN z >= 3 THEN least(0.4 + 0.08 * (z - 3), 0.8) ELSE 0 END + CASE WHEN rt >= 5 THEN least(0.25 * rt / 5, 0.4) ELSE 0 END + CASE WHEN off_hours_flag = 1 AND (z >= 2 OR rt >= 3) THEN 0.2 ELSE 0 END
   + CASE WHEN destination_novel = 1 AND (z >= 2 OR rt >= 3) THEN 0.15 ELSE 0 END + CASE WHEN dr > 0 AND dr < 0.001 AND rt >= 2 THEN 0.15 ELSE 0 END)) AS c FROM ey GROUP BY src_ip, dst_ip),
  {_RECON}, scans AS (SELECT src_ip, least(1, greatest(CASE WHEN unique_dst_ports >= 15 THEN least(0.4 + 0.2 * (unique_dst_ports / 15 - 1), 0.8) ELSE 0 END, CASE WHEN unique_dst_hosts >= 10 THEN least(0.4 + 0.2 * (unique_dst_hosts / 10 - 1), 0.8) ELSE 0 END)
   + CASE WHEN scan_rate >= 5 AND (unique_dst_ports > 3 OR unique_dst_hosts > 3) THEN least(0.15 * scan_rate / 5, 0.25) ELSE 0 END + CASE WHEN syn_no_completion_ratio >= 0.7 AND (unique_dst_ports > 5 OR unique_dst_hosts > 5) THEN 0.2 * syn_no_completion_ratio ELSE 0 END
   + CASE WHEN port_sequence_score >= 0.5 AND unique_dst_ports >= 5 THEN 0.15 * port_sequence_score ELSE 0 END) AS c FROM recon),
  pairs AS (SELECT src_ip, dst_ip, max(end_time) AS ts, arg_max(flow_id, (end_time, first_seq)) AS flow_id FROM flows GROUP BY src_ip, dst_ip),
  six AS (SELECT p.*, round(coalesce(f.c, 0)::DOUBLE, 4) AS ddos, round(coalesce(b.c, 0)::DOUBLE, 4) AS c2_beacon, round(coalesce(n.c, 0)::DOUBLE, 4) AS dga_dns, round(coalesce(h.c, 0)::DOUBLE, 4) AS encrypted_malware, round(coalesce(s.c, 0)::DOUBLE, 4) AS recon_scan, round(coalesce(v.c, 0)::DOUBLE, 4) AS exfiltration
   FROM pairs p LEFT JOIN floods f USING (dst_ip) LEFT JOIN beacons b USING (src_ip) LEFT JOIN names_judged n USING (src_ip) LEFT JOIN hellos h ON h.src_ip = p.src_ip AND h.dst_ip = p.dst_ip LEFT JOIN scans s ON s.src_ip = p.src_ip LEFT JOIN volumes v ON v.src_ip = p.src_ip AND v.dst_ip = p.dst_ip)"""


def _scores(spark, sf_dir):
    packets = written(with_hellos(view(spark, sf_dir, "packets")), "threat-packets")
    questions = packets.where(_ASKS).select("seq", "src_ip", "ts", F.expr("concat('host', seq % 5, '.example.com')").alias("qname"), F.expr("cast(1 + seq % 30 AS string)").alias("qtype"))
    text = spark.range(1).select(F.lit(_WORDS).alias("text"))  # a fixed list
    flows = written(fl.build(packets, IDLE), "threat-flows")
    return threats.scores(flows, packets, questions, (ngram.fit(text, "text", 2), ngram.fit(text, "text", 3)), net.BAD_JA3 | _DENIED)


@query(f"{_SIX} SELECT src_ip, dst_ip, round(ts, 6) AS ts, flow_id, ddos, c2_beacon, dga_dns, encrypted_malware, recon_scan, exfiltration FROM six")
def d_six_classes(spark, sf_dir):
    """Confidence of each class per source and destination, from packets: flows, handshakes, questions, features, models and rules with their own limits."""
    return rounded(_scores(spark, sf_dir))


@query(f"""{_SIX}, candidates AS (UNPIVOT (SELECT src_ip, dst_ip, ts, flow_id, ddos, c2_beacon, dga_dns, encrypted_malware, recon_scan, exfiltration FROM six) ON ddos, c2_beacon, dga_dns, encrypted_malware, recon_scan, exfiltration INTO NAME threat_class VALUE confidence),
  alerts AS (SELECT * FROM candidates WHERE confidence >= 0.25), {_SEVERE} SELECT threat_class, severity, count(*) AS n, round(avg(confidence), 3) AS avg_confidence FROM severe GROUP BY GROUPING SETS ((), (threat_class), (severity))""")
def q_threat_alerts(spark, sf_dir):
    """Alerts of all six classes, counted by class and severity."""
    return aq.counts(threats.alerts(_scores(spark, sf_dir), WINDOW))
