"""Every traffic query by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.fixtures import oracle, view
from flowloom.functions import net, ngram
from flowloom.operators import alerts as al
from flowloom.operators import detectors as det
from flowloom.operators import features as feat
from flowloom.operators import flows as fl
from flowloom.operators import replay, selection, training
from flowloom.plans import alert_queries as aq

IDLE, WINDOW, NOW = 259_200.0, 2_592_000.0, 883_612_800.0
_Q: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def add(f):
        _Q[f.__name__] = (f, sql)
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(net.half_away(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _with(*names: str) -> str:
    return "WITH " + ", ".join(oracle(n) for n in names)


def _severe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return al.with_severity(view(spark, sf_dir, "alerts"))


_WEIGHT = "CASE lower(threat_class) WHEN 'exfiltration' THEN 1.0 WHEN 'c2_beacon' THEN 0.95 WHEN 'encrypted_malware' THEN 0.9 WHEN 'ddos' THEN 0.9 WHEN 'dga_dns' THEN 0.85 WHEN 'recon_scan' THEN 0.65 ELSE 0.75 END::DOUBLE"
_SEVERE = f"""severe AS (SELECT *, confidence * {_WEIGHT} AS s, CASE WHEN s >= 0.75 THEN 'CRITICAL' WHEN s >= 0.55 THEN 'HIGH' WHEN s >= 0.35 THEN 'MEDIUM' ELSE 'LOW' END AS severity, round(round(s, 6)::DECIMAL(18, 6), 4)::DOUBLE AS severity_score FROM alerts)"""
_ALERTS = f"{_with('alerts')}, {_SEVERE}"
_KEYED = """keyed AS (SELECT *, (src_ip, src_port) <= (dst_ip, dst_port) AS is_forward, CASE WHEN is_forward THEN src_ip ELSE dst_ip END AS ip_a, CASE WHEN is_forward THEN src_port ELSE dst_port END AS port_a,
  CASE WHEN is_forward THEN dst_ip ELSE src_ip END AS ip_b, CASE WHEN is_forward THEN dst_port ELSE src_port END AS port_b,
  substr(sha256(ip_a || ':' || port_a || '-' || ip_b || ':' || port_b || '-' || protocol), 1, 16) AS flow_id FROM packets)"""
_FLOWS = f"""{_KEYED}, gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= {IDLE} THEN 1 ELSE 0 END AS is_new FROM keyed WINDOW w AS (PARTITION BY flow_id ORDER BY seq)),
  numbered AS (SELECT *, sum(is_new) OVER (PARTITION BY flow_id ORDER BY seq) AS flow_no FROM gaps),
  built AS (SELECT flow_id, flow_no::BIGINT AS flow_no, arg_min(src_ip, seq) AS src_ip, arg_min(dst_ip, seq) AS dst_ip, arg_min(src_port, seq) AS src_port, arg_min(dst_port, seq) AS dst_port, any_value(protocol) AS protocol,
   count(*) FILTER (is_forward) AS packets_fwd, count(*) FILTER (NOT is_forward) AS packets_bwd, sum(CASE WHEN is_forward THEN length ELSE 0 END)::BIGINT AS bytes_fwd, sum(CASE WHEN is_forward THEN 0 ELSE length END)::BIGINT AS bytes_bwd,
   packets_fwd + packets_bwd AS total_packets, bytes_fwd + bytes_bwd AS total_bytes, arg_min(ts, seq) AS start_time, arg_max(ts, seq) AS end_time, end_time - start_time AS duration, min(seq) AS first_seq FROM numbered GROUP BY flow_id, flow_no)"""
_NAMES = """names AS (SELECT seq, qname, qtype, src_ip, ts, string_split(lower(rtrim(qname, '.')), '.') AS parts FROM dns_queries),
  labelled AS (SELECT *, CASE WHEN len(parts) < 2 THEN parts[1] WHEN len(parts) >= 3 AND length(parts[-2]) <= 3 THEN parts[-3] ELSE parts[-2] END AS label,
   CASE WHEN len(parts) >= 3 THEN array_to_string(parts[-2:], '.') END AS apex, CASE WHEN len(parts) >= 3 THEN array_to_string(parts[1:len(parts)-2], '.') END AS sub FROM names),
  chars AS (SELECT label, unnest(string_split(label, '')) AS c FROM (SELECT DISTINCT label FROM labelled)), shares AS (SELECT label, c, count(*) AS n FROM chars WHERE c <> '' GROUP BY ALL),
  ent AS (SELECT label, CASE WHEN sum(n) > 1 THEN -sum((n / length(label)) * log2(n / length(label))) ELSE 0.0 END AS entropy FROM shares GROUP BY label)"""


@query(f"""{_with('packets')}, {_KEYED} SELECT seq, ip_a, port_a, ip_b, port_b, protocol, is_forward, flow_id FROM keyed""")
def p_flow_keys(spark, sf_dir):
    return fl.keyed(view(spark, sf_dir, "packets")).select("seq", "ip_a", "port_a", "ip_b", "port_b", "protocol", "is_forward", net.flow_id().alias("flow_id"))


@query(f"""{_with('dns_queries')}, {_NAMES} SELECT seq, label, apex, sub, round(entropy, 6) AS entropy, length(label)::INT AS label_length, len(string_split(rtrim(qname, '.'), '.'))::INT AS num_labels,
  round(length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label), 6) AS digit_ratio, round(length(regexp_replace(label, '[^b-df-hj-np-tv-z]', '', 'g')) / length(label), 6) AS consonant_ratio FROM labelled JOIN ent USING (label)""")
def p_domain_scores(spark, sf_dir):
    q, label = F.col("qname"), F.col("label")
    rows = view(spark, sf_dir, "dns_queries").withColumn("label", net.label_of(q))
    return rounded(rows.select("seq", "label", net.apex_of(q).alias("apex"), net.subdomain_of(q).alias("sub"), net.entropy_of_text(label).alias("entropy"), F.length(label).alias("label_length"), F.size(F.split(F.rtrim(q, F.lit(".")), r"\.")).alias("num_labels"), net.ratio_of(label, "0-9").alias("digit_ratio"), net.ratio_of(label, "b-df-hj-np-tv-z").alias("consonant_ratio")))


@query("""SELECT p_partkey, '771,' || p_size || '-' || (p_size + 1) || ',0-10-11,23-' || (p_partkey % 30) || ',0' AS ja3_text, md5(ja3_text) AS ja3, FALSE AS denied FROM part""")
def p_ja3(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    ints = lambda *x: F.array(*(F.lit(v).cast("int") if isinstance(v, int) else v.cast("int") for v in x))
    text = net.ja3_text(F.lit(771), ints(F.col("p_size"), F.col("p_size") + 1, 2570), ints(0, 10, 11), ints(23, F.col("p_partkey") % 30), ints(0))
    return part.select("p_partkey", text.alias("ja3_text")).withColumn("ja3", F.md5("ja3_text")).withColumn("denied", F.col("ja3").isin(*net.BAD_JA3))


@query(f"{_ALERTS} SELECT alert_id, severity, severity_score FROM severe")
def p_severity(spark, sf_dir):
    return _severe(spark, sf_dir).select("alert_id", "severity", "severity_score")


@query(f"""{_with('packets')} SELECT seq, round(sum(length) OVER (ORDER BY seq) * 8 / 5e6, 6) AS release_ts, round(1e9 + greatest(0, ts - first_value(ts) OVER (ORDER BY seq)), 6) AS live_ts FROM packets""")
def s_replay_pacing(spark, sf_dir):
    """Release times at 5 Mbit/s and times moved to a new start."""
    return rounded(replay.paced(view(spark, sf_dir, "packets"), 5.0, 1e9).select("seq", "release_ts", "live_ts"))


@query(f"""{_with('packets')} SELECT count(*) AS total_packets, sum(length)::BIGINT AS total_bytes, round(max(ts) - min(ts), 6) AS elapsed_seconds, round(sum(length) * 8 / ((max(ts) - min(ts)) * 1e6), 9) AS effective_mbps FROM packets""")
def s_replay_stats(spark, sf_dir):
    span = F.max("ts") - F.min("ts")
    out = view(spark, sf_dir, "packets").agg(F.count("*").alias("total_packets"), F.sum("length").alias("total_bytes"), span.alias("elapsed_seconds"), (F.sum("length") * 8 / (span * 1e6)).alias("effective_mbps"))
    return out.select("total_packets", "total_bytes", F.round("elapsed_seconds", 6).alias("elapsed_seconds"), F.round("effective_mbps", 9).alias("effective_mbps"))


@query(f"""{_with('alerts')} SELECT flow_id, max(ts) AS ts, arg_max(alert_id, (ts, alert_id)) AS alert_id, arg_max(confidence, (ts, alert_id)) AS confidence FROM alerts GROUP BY flow_id""")
def s_upsert(spark, sf_dir):
    rows = view(spark, sf_dir, "alerts").select("flow_id", "ts", "alert_id", "confidence").withColumn("__o", F.struct("ts", "alert_id"))
    return fl.latest(rows, "flow_id", "__o").select("flow_id", "ts", "alert_id", "confidence")


@query(f"""{_with('packets')}, {_FLOWS} SELECT flow_id, flow_no, src_ip, dst_ip, src_port, dst_port, protocol, packets_fwd, packets_bwd, bytes_fwd, bytes_bwd, total_packets, total_bytes, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, round(duration, 6) AS duration FROM built""")
def f_flows(spark, sf_dir):
    return rounded(fl.build(view(spark, sf_dir, "packets"), IDLE).drop("first_seq"))


@query(f"""{_with('packets')} SELECT seq, src_ip, dst_ip FROM packets QUALIFY row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY seq) <= 30""")
def f_first_per_pair(spark, sf_dir):
    from pyspark.sql import Window

    rows = view(spark, sf_dir, "packets").withColumn("__r", F.row_number().over(Window.partitionBy("src_ip", "dst_ip").orderBy("seq")))
    return rows.where("__r <= 30").select("seq", "src_ip", "dst_ip")


@query(f"""{_with('flows')}, g AS (SELECT dst_ip, greatest(max(start_time + duration) - min(start_time), 1e-9) AS span, sum(packets_fwd + packets_bwd) AS p, sum(bytes_fwd + bytes_bwd) AS b, count(DISTINCT src_ip) AS u, entropy(src_ip) AS e FROM flows GROUP BY dst_ip),
  m AS (SELECT dst_ip, max(n) / sum(n) AS mix FROM (SELECT dst_ip, protocol, count(*) AS n FROM flows GROUP BY ALL) GROUP BY dst_ip)
  SELECT dst_ip, round(p / span, 6) AS packets_per_sec, round(b / span, 6) AS bytes_per_sec, u AS unique_src_count, round(u / span, 6) AS unique_src_per_sec, round(e, 6) AS src_ip_entropy, round(mix, 6) AS protocol_mix_ratio FROM g JOIN m USING (dst_ip)""")
def a_ddos(spark, sf_dir):
    return rounded(feat.ddos(view(spark, sf_dir, "flows"), ["dst_ip"]))


@query(f"""{_with('packets')}, {_KEYED}, k AS (SELECT dst_ip, ip_a, port_a, ip_b, port_b, protocol, count(*) FILTER (tcp_flags & 2 <> 0) AS syn, count(*) FILTER (tcp_flags & 16 <> 0) AS ack, count(*) FILTER (tcp_flags & 2 <> 0 AND tcp_flags & 16 = 0) AS bare, count(*) FILTER (NOT is_forward) AS back FROM keyed GROUP BY ALL)
  SELECT dst_ip, round(CASE WHEN sum(ack) = 0 THEN 0 ELSE sum(syn) / sum(ack) END, 6) AS syn_ack_ratio, greatest(sum(bare) - count(*) FILTER (protocol = 6 AND back > 0), 0)::BIGINT AS half_open_count FROM k GROUP BY dst_ip""")
def a_handshakes(spark, sf_dir):
    return rounded(feat.handshakes(view(spark, sf_dir, "packets"), ["dst_ip"]))


_RECON = """r AS (SELECT src_ip, count(DISTINCT dst_ip) AS unique_dst_hosts, CASE WHEN count(*) FILTER (protocol = 6) = 0 THEN 0 ELSE count(*) FILTER (protocol = 6 AND packets_fwd > 0 AND packets_bwd = 0) / count(*) FILTER (protocol = 6) END AS syn_no_completion_ratio,
   count(*) / greatest(max(start_time + duration) - min(start_time), 1e-9) AS scan_rate FROM flows GROUP BY src_ip),
  o AS (SELECT src_ip, dst_port, lead(dst_port) OVER (PARTITION BY src_ip ORDER BY dst_port) AS nx FROM (SELECT DISTINCT src_ip, dst_port FROM flows)),
  p AS (SELECT src_ip, count(*) AS unique_dst_ports, CASE WHEN count(*) > 1 THEN count(*) FILTER (nx - dst_port = 1) / (count(*) - 1) ELSE 0 END AS port_sequence_score FROM o GROUP BY src_ip),
  recon AS (SELECT * FROM r JOIN p USING (src_ip))"""


@query(f"""{_with('flows')}, {_RECON} SELECT src_ip, unique_dst_hosts, unique_dst_ports, round(syn_no_completion_ratio, 6) AS syn_no_completion_ratio, round(scan_rate, 6) AS scan_rate, round(port_sequence_score, 6) AS port_sequence_score FROM recon""")
def a_recon(spark, sf_dir):
    return rounded(feat.recon(view(spark, sf_dir, "flows"), ["src_ip"]))


@query(f"""{_with('flows')}, g AS (SELECT *, start_time - lag(start_time) OVER (PARTITION BY src_ip ORDER BY start_time, seq) AS gap, (bytes_fwd + bytes_bwd)::DOUBLE AS size FROM flows)
  SELECT src_ip, round(coalesce(avg(gap), 0), 4) AS iat_mean, round(coalesce(var_pop(gap), 0) / 1e6, 2) AS iat_variance, round(coalesce(stddev_pop(gap) / avg(gap), 0), 6) AS iat_cv, count(DISTINCT dst_ip) AS dst_cardinality, round(avg(duration), 6) AS session_duration_mean,
  round(CASE WHEN avg(duration) < 1e-12 THEN 0 ELSE stddev_pop(duration) / avg(duration) END, 6) AS session_duration_cv, round(stddev_pop(size) / avg(size), 6) AS byte_size_cv FROM g GROUP BY src_ip""")
def a_beacon(spark, sf_dir):
    out = rounded(feat.beacon(view(spark, sf_dir, "flows"), ["src_ip"]).withColumn("iat_variance", F.col("iat_variance") / 1e6))
    return out.withColumns({"iat_mean": F.round("iat_mean", 4), "iat_variance": F.round("iat_variance", 2)})


@query(f"""{_with('flows')}, s AS (SELECT src_ip, min(start_time) AS t0, max(start_time) AS t1, count(*) AS n FROM flows GROUP BY src_ip),
  c AS (SELECT src_ip, least(floor((start_time - t0) / ((t1 - t0) / 256)), 255) AS b, count(*) AS n FROM flows JOIN s USING (src_ip) WHERE s.n >= 4 AND t1 - t0 >= 1e-9 GROUP BY ALL),
  w AS (SELECT src_ip, k, pow(sum(c.n * cos(k * b * (-2 * 3.141592653589793 / 256))), 2) + pow(sum(c.n * sin(k * b * (-2 * 3.141592653589793 / 256))), 2) AS p FROM c, range(1, 129) t(k) GROUP BY src_ip, k),
  x AS (SELECT src_ip, max(p) / sum(p) AS score FROM w GROUP BY src_ip) SELECT s.src_ip, round(coalesce(score, 0.0), 6) AS periodicity_score FROM s LEFT JOIN x USING (src_ip)""")
def a_periodicity(spark, sf_dir):
    return rounded(feat.periodicity(view(spark, sf_dir, "flows"), ["src_ip"]))


@query(f"""{_with('dns_queries')}, {_NAMES}, j AS (SELECT * FROM labelled LEFT JOIN ent USING (label)),
  subs AS (SELECT src_ip, avg(n) AS s FROM (SELECT src_ip, apex, count(DISTINCT sub) AS n FROM labelled WHERE apex IS NOT NULL GROUP BY ALL) GROUP BY src_ip)
  SELECT j.src_ip, round(avg(entropy), 6) AS mean_entropy, round(avg(length(label)), 6) AS mean_label_length, max(length(label))::INT AS max_label_length, round(avg(length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label)), 6) AS mean_digit_ratio,
  round(avg(CASE WHEN upper(qtype) IN ('TXT','NULL','CNAME','MX','10','16','255') THEN 1 ELSE 0 END), 6) AS txt_null_ratio, round(CASE WHEN count(*) >= 2 THEN count(*) / greatest(max(ts) - min(ts), 1e-9) ELSE 0 END, 6) AS query_rate,
  count(DISTINCT qname) AS unique_qnames, round(coalesce(any_value(s), 0), 6) AS unique_subdomains_per_apex FROM j LEFT JOIN subs ON subs.src_ip = j.src_ip GROUP BY j.src_ip""")
def a_dns(spark, sf_dir):
    return rounded(feat.dns(view(spark, sf_dir, "dns_queries"), ["src_ip"]))


_EXFIL = """x AS (SELECT *, avg(bytes_fwd) OVER w AS m, stddev_pop(bytes_fwd) OVER w AS sd, count(*) OVER w AS n, row_number() OVER (PARTITION BY src_ip, dst_ip ORDER BY start_time, seq) AS r FROM flows
   WINDOW w AS (PARTITION BY src_ip ORDER BY start_time, seq ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
  exfil AS (SELECT seq, src_ip, dst_ip, CASE WHEN bytes_bwd = 0 THEN 0 ELSE bytes_fwd / bytes_bwd END AS outbound_inbound_ratio, CASE WHEN n < 2 THEN 0 WHEN sd < 1e-9 THEN CASE WHEN bytes_fwd > m THEN 'inf'::DOUBLE ELSE 0 END ELSE (bytes_fwd - m) / sd END AS outbound_volume_zscore,
   CASE WHEN bytes_fwd + bytes_bwd = 0 THEN 0 ELSE duration / (bytes_fwd + bytes_bwd) END AS duration_bytes_ratio, CASE WHEN start_time <= 0 THEN 0 WHEN (start_time::BIGINT // 3600) % 24 BETWEEN 9 AND 16 THEN 0 ELSE 1 END AS off_hours_flag, CASE WHEN r = 1 THEN 1 ELSE 0 END AS destination_novel FROM x)"""


@query(f"""{_with('flows')}, {_EXFIL} SELECT seq, src_ip, dst_ip, round(outbound_inbound_ratio, 6) AS outbound_inbound_ratio, round(outbound_volume_zscore, 6) AS outbound_volume_zscore, round(duration_bytes_ratio, 6) AS duration_bytes_ratio, off_hours_flag, destination_novel FROM exfil""")
def a_exfiltration(spark, sf_dir):
    return rounded(feat.exfiltration(view(spark, sf_dir, "flows")))


@query(f"""{_with('packets')}, o AS (SELECT *, row_number() OVER w AS r, ts - lag(ts) OVER w AS gap FROM packets WINDOW w AS (PARTITION BY src_ip, dst_ip ORDER BY ts, seq))
  SELECT src_ip, dst_ip, round(avg(length), 6) AS pkt_size_mean, round(stddev_pop(length), 6) AS pkt_size_std, round(coalesce(avg(gap), 0), 3) AS pkt_ipt_mean, round(coalesce(stddev_pop(gap), 0), 3) AS pkt_ipt_std FROM o WHERE r <= 10 GROUP BY ALL""")
def a_first_packets(spark, sf_dir):
    out = rounded(feat.first_packets(view(spark, sf_dir, "packets"), ["src_ip", "dst_ip"]))
    return out.withColumns({"pkt_ipt_mean": F.round("pkt_ipt_mean", 3), "pkt_ipt_std": F.round("pkt_ipt_std", 3)})


@query(f"""{_with('flows')}, {_RECON}, t AS (SELECT *, greatest(CASE WHEN unique_dst_ports >= 15 THEN least(0.4 + 0.2 * (unique_dst_ports / 15 - 1), 0.8) ELSE 0 END, CASE WHEN unique_dst_hosts >= 10 THEN least(0.4 + 0.2 * (unique_dst_hosts / 10 - 1), 0.8) ELSE 0 END)
   + CASE WHEN scan_rate >= 5 AND (unique_dst_ports > 3 OR unique_dst_hosts > 3) THEN least(0.15 * scan_rate / 5, 0.25) ELSE 0 END + CASE WHEN syn_no_completion_ratio >= 0.7 AND (unique_dst_ports > 5 OR unique_dst_hosts > 5) THEN 0.2 * syn_no_completion_ratio ELSE 0 END
   + CASE WHEN port_sequence_score >= 0.5 AND unique_dst_ports >= 5 THEN 0.15 * port_sequence_score ELSE 0 END AS total FROM recon) SELECT src_ip, round(least(greatest(total, 0), 1), 4)::DOUBLE AS confidence FROM t""")
def d_recon(spark, sf_dir):
    return det.recon(feat.recon(view(spark, sf_dir, "flows"), ["src_ip"])).select("src_ip", "confidence")


@query(f"""{_with('flows')}, {_EXFIL}, y AS (SELECT *, CASE WHEN isnan(outbound_volume_zscore) THEN 0 WHEN outbound_volume_zscore > 50 THEN 10 ELSE outbound_volume_zscore END AS z, outbound_inbound_ratio AS r, duration_bytes_ratio AS d FROM exfil),
  t AS (SELECT seq, CASE WHEN z >= 3 THEN least(0.4 + 0.08 * (z - 3), 0.8) ELSE 0 END + CASE WHEN r >= 5 THEN least(0.25 * r / 5, 0.4) ELSE 0 END + CASE WHEN off_hours_flag = 1 AND (z >= 2 OR r >= 3) THEN 0.2 ELSE 0 END
   + CASE WHEN destination_novel = 1 AND (z >= 2 OR r >= 3) THEN 0.15 ELSE 0 END + CASE WHEN d > 0 AND d < 0.001 AND r >= 2 THEN 0.15 ELSE 0 END AS total FROM y) SELECT seq, round(least(greatest(total, 0), 1), 4)::DOUBLE AS confidence FROM t""")
def d_exfiltration(spark, sf_dir):
    return det.exfiltration(feat.exfiltration(view(spark, sf_dir, "flows"))).select("seq", "confidence")


@query(f"""{_with('alerts')} SELECT alert_id FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY src_ip, dst_ip, lower(threat_class) ORDER BY ts, alert_id) AS gap FROM alerts WHERE confidence >= 0.25) WHERE gap IS NULL OR gap >= {WINDOW}""")
def t_dedup(spark, sf_dir):
    return al.deduplicate(view(spark, sf_dir, "alerts"), WINDOW).select("alert_id")


@query(f"""{_with('alerts')}, k AS (SELECT *, ts - lag(ts) OVER (PARTITION BY src_ip, dst_ip, lower(threat_class) ORDER BY ts, alert_id) AS gap FROM alerts WHERE confidence >= 0.25)
  SELECT (SELECT count(*) FROM alerts) AS raw, (SELECT count(*) FROM k WHERE gap < {WINDOW}) AS suppressed, (SELECT count(*) FROM k WHERE gap IS NULL OR gap >= {WINDOW}) AS emitted""")
def t_counters(spark, sf_dir):
    raw = view(spark, sf_dir, "alerts")
    emitted = al.deduplicate(raw, WINDOW).agg(F.count("*").alias("emitted"))
    totals = raw.agg(F.count("*").alias("raw"), F.count_if(F.col("confidence") >= al.FLOOR).alias("above"))
    return totals.crossJoin(emitted).select("raw", (F.col("above") - F.col("emitted")).alias("suppressed"), "emitted")  # one row each


@query(f"""{_ALERTS} SELECT alert_id, ts, threat_class, severity FROM severe WHERE lower(threat_class) = 'ddos' AND severity = 'HIGH' AND src_ip ILIKE '%10.1.0.1%' ORDER BY ts DESC, alert_id LIMIT 20 OFFSET 5""")
def q_alert_page(spark, sf_dir):
    return aq.page(_severe(spark, sf_dir), threat="DDoS", severity="high", text="10.1.0.1", limit=20, offset=5).select("alert_id", "ts", "threat_class", "severity")


@query(f"""{_ALERTS} SELECT threat_class, severity, count(*) AS n, round(avg(confidence), 3) AS avg_confidence FROM severe GROUP BY GROUPING SETS ((), (threat_class), (severity))""")
def q_summary(spark, sf_dir):
    return aq.counts(_severe(spark, sf_dir))


@query(f"{_with('alerts')} SELECT src_ip, count(*) AS n FROM alerts GROUP BY src_ip ORDER BY n DESC, src_ip LIMIT 5")
def q_top_sources(spark, sf_dir):
    return aq.top(view(spark, sf_dir, "alerts"), "src_ip")


@query(f"{_with('alerts')} SELECT dst_ip, count(*) AS n FROM alerts GROUP BY dst_ip ORDER BY n DESC, dst_ip LIMIT 5")
def q_top_destinations(spark, sf_dir):
    return aq.top(view(spark, sf_dir, "alerts"), "dst_ip")


@query(f"""{_ALERTS} SELECT (floor(ts / 86400) * 86400)::BIGINT AS bucket, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low FROM severe GROUP BY 1""")
def q_trends(spark, sf_dir):
    return aq.trends(_severe(spark, sf_dir), 86_400)


@query(f"""{_with('alerts', 'flows')}, f AS (SELECT 'flow-' || seq AS flow_id, bytes_fwd FROM flows WHERE seq < 1000) SELECT alert_id, flow_id, bytes_fwd FROM alerts LEFT JOIN f USING (flow_id)""")
def q_alert_flows(spark, sf_dir):
    flows = view(spark, sf_dir, "flows").select(F.concat(F.lit("flow-"), F.col("seq").cast("string")).alias("flow_id"), "bytes_fwd")
    return aq.with_flow(view(spark, sf_dir, "alerts"), flows).select("alert_id", "flow_id", "bytes_fwd")


@query("""WITH c AS (SELECT label, session_id, row_number() OVER (PARTITION BY label ORDER BY md5('42-' || session_id), session_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT lang AS label, source AS session_id FROM documents)),
  k AS (SELECT *, greatest(1, floor(0.7 * n)) AS t, t + greatest(1, floor(0.15 * n)) AS v FROM c),
  s AS (SELECT label, session_id, unnest(CASE WHEN r <= t THEN ['train'] WHEN r <= v THEN CASE WHEN n <= v THEN ['validation', 'test'] ELSE ['validation'] END ELSE ['test'] END) AS part FROM k WHERE n >= 3)
  SELECT doc_id AS flow_index, lang AS label, part FROM documents JOIN s ON s.label = lang AND s.session_id = source""")
def m_session_split(spark, sf_dir):
    """Documents stand for flows, their sources for sessions (three or more a language)."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("flow_index"), F.col("lang").alias("label"), F.col("source").alias("session_id"))
    return training.split(rows).select("flow_index", "label", "part")


@query("""WITH c AS (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tp, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS tn FROM labels)
  SELECT tp, fp, fn, tn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def m_metrics(spark, sf_dir):
    """Freedom from toxicity as a guess at quality."""
    return rounded(training.metrics(spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("guess", 1 - F.col("toxic")), "quality", "guess"))


@query(f"""{_with('packets')}, p AS (SELECT least(src_ip, dst_ip) AS a, greatest(src_ip, dst_ip) AS b, count(*) AS n, sum(length)::BIGINT AS bytes FROM packets GROUP BY ALL), {_FLOWS}
  SELECT flow_id, flow_no, n AS pair_packets, bytes AS pair_bytes FROM built JOIN p ON a = least(src_ip, dst_ip) AND b = greatest(src_ip, dst_ip)""")
def m_flow_packets(spark, sf_dir):
    """Packets of either direction between a flow's two hosts: one hash join on the ordered pair."""
    packets = view(spark, sf_dir, "packets")
    pair = [F.least("src_ip", "dst_ip").alias("a"), F.greatest("src_ip", "dst_ip").alias("b")]
    sums = packets.groupBy(*pair).agg(F.count("*").alias("pair_packets"), F.sum("length").alias("pair_bytes"))
    return fl.build(packets, IDLE).select("flow_id", "flow_no", *pair).join(sums, ["a", "b"]).select("flow_id", "flow_no", "pair_packets", "pair_bytes")


@query(f"""{_with('flows')} SELECT round(median(duration), 6) AS median_latency, round(quantile_cont(duration, 0.95), 6) AS p95_latency FROM flows""")
def b_percentiles(spark, sf_dir):
    median, p95 = selection.quantiles(view(spark, sf_dir, "flows"), "duration", [0.5, 0.95])
    return rounded(spark.range(1).select(F.lit(median).cast("double").alias("median_latency"), F.lit(p95).cast("double").alias("p95_latency")))


@query(f"""{_with('packets')}, {_KEYED}, o AS (SELECT flow_id, length::DOUBLE AS v, row_number() OVER w AS r, count(*) OVER (PARTITION BY flow_id) AS n FROM keyed WINDOW w AS (PARTITION BY flow_id ORDER BY seq))
  SELECT flow_id, round(sum(CASE WHEN r = 1 THEN v ELSE 0.3 * v END * pow(0.7, n - r)), 6) AS ewma FROM o GROUP BY flow_id""")
def d_ewma(spark, sf_dir):
    rows = fl.keyed(view(spark, sf_dir, "packets")).select("seq", F.col("length").cast("double").alias("v"), net.flow_id().alias("flow_id"))
    return rounded(fl.ewma(rows, ["flow_id"], ["seq"], "v"))


ACTIVE, TICK = 604_800.0, 21_600.0
_CLOCK = f"""{_KEYED}, c AS (SELECT *, lag(ts) OVER (ORDER BY seq) AS clock, row_number() OVER (PARTITION BY flow_id ORDER BY seq) AS r FROM keyed),
  walk AS (SELECT flow_id, r, seq, ts, length, 0::BIGINT AS flow_no, ts AS start FROM c WHERE r = 1
   UNION ALL SELECT c.flow_id, c.r, c.seq, c.ts, c.length, CASE WHEN c.clock - w.ts >= {IDLE} OR c.clock - w.start >= {ACTIVE} THEN w.flow_no + 1 ELSE w.flow_no END, CASE WHEN c.clock - w.ts >= {IDLE} OR c.clock - w.start >= {ACTIVE} THEN c.ts ELSE w.start END
   FROM walk w JOIN c ON c.flow_id = w.flow_id AND c.r = w.r + 1),
  timed AS (SELECT flow_id, flow_no, count(*) AS total_packets, sum(length)::BIGINT AS total_bytes, arg_min(ts, seq) AS start_time, arg_max(ts, seq) AS end_time FROM walk GROUP BY ALL),
  closed AS (SELECT t.*, CASE WHEN start_time + {ACTIVE} <= (SELECT max(ts) FROM packets) AND (p.ts IS NULL OR start_time + {ACTIVE} <= p.ts) THEN 'expired_active' WHEN p.ts IS NOT NULL THEN 'expired_idle' ELSE 'expired_flush' END AS state
   FROM timed t ASOF LEFT JOIN (SELECT DISTINCT ts FROM packets) p ON p.ts >= t.end_time + {IDLE})"""
_RECURSIVE = _with("packets").replace("WITH", "WITH RECURSIVE", 1)


@query(f"""{_RECURSIVE}, {_CLOCK} SELECT flow_id, flow_no, total_packets, total_bytes, round(start_time, 6) AS start_time, round(end_time, 6) AS end_time, state FROM closed""")
def f_flows_by_clock(spark, sf_dir):
    return rounded(fl.build_by_clock(view(spark, sf_dir, "packets"), IDLE, ACTIVE, width=86_400.0).select("flow_id", "flow_no", "total_packets", "total_bytes", "start_time", "end_time", "state"))


_BEATS = f"""seen AS (SELECT DISTINCT ts FROM packets), ends AS (SELECT t.*, p.ts AS closed_at FROM timed t ASOF LEFT JOIN seen p ON p.ts >= least(t.start_time + {ACTIVE}, t.end_time + {IDLE})),
  nexts AS (SELECT a.ts, b.ts AS nts FROM seen a ASOF JOIN seen b ON b.ts >= a.ts + {TICK}), firsts AS (SELECT ts, min(seq) AS s FROM packets GROUP BY ts),
  beats AS (SELECT flow_id, flow_no, 1::BIGINT AS tick, closed_at, nts AS at FROM ends JOIN nexts ON ts = start_time WHERE closed_at IS NULL OR nts < closed_at
   UNION ALL SELECT b.flow_id, b.flow_no, b.tick + 1, b.closed_at, n.nts FROM beats b JOIN nexts n ON n.ts = b.at WHERE b.closed_at IS NULL OR n.nts < b.closed_at)"""


@query(f"""{_RECURSIVE}, {_CLOCK}, {_BEATS} SELECT b.flow_id, b.flow_no, b.tick, round(b.at, 6) AS at, count(*) AS total_packets, sum(length)::BIGINT AS total_bytes
  FROM beats b JOIN firsts f ON f.ts = b.at JOIN walk w ON w.flow_id = b.flow_id AND w.flow_no = b.flow_no AND w.seq <= f.s GROUP BY ALL""")
def f_ticks(spark, sf_dir):
    return rounded(fl.ticks(view(spark, sf_dir, "packets"), IDLE, ACTIVE, TICK, width=86_400.0))


LATER = 200_000.0


@query(f"""{_RECURSIVE}, {_CLOCK}, late AS (SELECT DISTINCT ts FROM packets UNION SELECT max(ts) + {LATER} FROM packets),
  looked AS (SELECT t.*, p.ts AS closed_at FROM timed t ASOF LEFT JOIN late p ON p.ts >= least(t.start_time + {ACTIVE}, t.end_time + {IDLE}))
  SELECT flow_id, flow_no, total_packets, round(closed_at, 6) AS closed_at, CASE WHEN closed_at IS NULL THEN 'expired_flush' WHEN closed_at >= start_time + {ACTIVE} THEN 'expired_active' ELSE 'expired_idle' END AS state FROM looked""")
def f_flows_as_of(spark, sf_dir):
    """A look at all open flows some time after the last packet."""
    packets = view(spark, sf_dir, "packets")
    last = packets.agg(F.max("ts")).first()[0] or 0.0
    return rounded(fl.build_by_clock(packets, IDLE, ACTIVE, as_of=last + LATER, width=86_400.0).select("flow_id", "flow_no", "total_packets", "closed_at", "state"))


@query(f"""{_RECURSIVE}, {_CLOCK} SELECT sum(total_packets)::BIGINT AS packets, count(*) AS created, count(*) FILTER (state <> 'expired_flush') AS expired, count(*) FILTER (state = 'expired_flush') AS active FROM closed""")
def f_lifetime(spark, sf_dir):
    return fl.lifetime(fl.build_by_clock(view(spark, sf_dir, "packets"), IDLE, ACTIVE, width=86_400.0))


def _gram_sql(n: int) -> str:
    return f"""m{n} AS (SELECT g, count(*) AS c FROM (SELECT substr(text, i, {n}) AS g FROM (SELECT text, unnest(range(1, length(text) - {n} + 2)) AS i FROM corpus)) GROUP BY g),
  s{n} AS (SELECT label, avg(log2((coalesce(c, 0) + 1) / ((SELECT sum(c) FROM m{n}) + (SELECT count(*) FROM m1)::DOUBLE ** {n}))) AS score FROM (SELECT label, substr(label, i, {n}) AS g FROM (SELECT label, unnest(range(1, length(label) - {n} + 2)) AS i FROM (SELECT DISTINCT label FROM labelled))) LEFT JOIN m{n} USING (g) GROUP BY label)"""


@query(f"""{_with('dns_queries')}, {_NAMES}, corpus AS (SELECT string_agg(lower(n_name), ' ' ORDER BY n_name) AS text FROM nation), {_gram_sql(1)}, {_gram_sql(2)}, {_gram_sql(3)}
  SELECT seq, label, round(coalesce(s2.score, 0), 6) AS bigram, round(coalesce(s3.score, 0), 6) AS trigram, round(0.4 * coalesce(s2.score, 0) + 0.6 * coalesce(s3.score, 0), 6) AS ngram_score FROM labelled LEFT JOIN s2 USING (label) LEFT JOIN s3 USING (label)""")
def p_ngrams(spark, sf_dir):
    names = spark.read.parquet(f"{sf_dir}/nation.parquet").agg(F.array_join(F.array_sort(F.collect_list(F.lower("n_name"))), " ").alias("text"))  # a fixed dimension
    rows = view(spark, sf_dir, "dns_queries").select("seq", net.label_of(F.col("qname")).alias("label"))
    for n, name in ((2, "bigram"), (3, "trigram")):
        rows = ngram.likelihood(rows, "label", ngram.fit(names, "text", n), name)
    return rounded(rows.select("seq", "label", "bigram", "trigram", ngram.combined(F.col("bigram"), F.col("trigram")).alias("ngram_score")))


_WIDE = "CASE WHEN {0} >= 2 THEN least(0.4 + 0.2 * ({0} / 2 - 1), 0.8) ELSE 0 END"


@query(f"""{_with('packets')}, {_FLOWS}, slots AS (SELECT *, floor(start_time / {WINDOW})::BIGINT AS slot FROM built),
  r AS (SELECT src_ip, slot, count(DISTINCT dst_ip) AS h, CASE WHEN count(*) FILTER (protocol = 6) = 0 THEN 0 ELSE count(*) FILTER (protocol = 6 AND packets_fwd > 0 AND packets_bwd = 0) / count(*) FILTER (protocol = 6) END AS lone,
   count(*) / greatest(max(start_time + duration) - min(start_time), 1e-9) AS rate, min(dst_ip) AS dst_ip, max(end_time) AS ts FROM slots GROUP BY src_ip, slot),
  o AS (SELECT src_ip, slot, dst_port, lead(dst_port) OVER (PARTITION BY src_ip, slot ORDER BY dst_port) AS nx FROM (SELECT DISTINCT src_ip, slot, dst_port FROM slots)),
  p AS (SELECT src_ip, slot, count(*) AS p, CASE WHEN count(*) > 1 THEN count(*) FILTER (nx - dst_port = 1) / (count(*) - 1) ELSE 0 END AS run FROM o GROUP BY src_ip, slot),
  scored AS (SELECT src_ip, dst_ip, slot, ts, 'recon_scan' AS threat_class, round(least(greatest({_WIDE.format('p')}, {_WIDE.format('h')}) + CASE WHEN rate >= 5 AND (p > 3 OR h > 3) THEN least(0.15 * rate / 5, 0.25) ELSE 0 END
   + CASE WHEN lone >= 0.7 AND (p > 5 OR h > 5) THEN 0.2 * lone ELSE 0 END + CASE WHEN run >= 0.5 AND p >= 5 THEN 0.15 * run ELSE 0 END, 1), 4) AS confidence FROM r JOIN p USING (src_ip, slot)),
  alerts AS (SELECT * FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY src_ip, dst_ip ORDER BY ts, slot) AS gap FROM scored WHERE confidence >= 0.25) WHERE gap IS NULL OR gap >= {2 * WINDOW}), {_SEVERE}
  SELECT threat_class, severity, count(*) AS n, round(avg(confidence), 3) AS avg_confidence FROM severe GROUP BY GROUPING SETS ((), (threat_class), (severity))""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets to flows, fan-out features by source and window of time, scan scores, suppression of repeats, severity, and counts by class and severity."""
    flows = fl.build(view(spark, sf_dir, "packets"), IDLE).withColumn("slot", F.floor(F.col("start_time") / WINDOW))
    features = feat.recon(flows, ["src_ip", "slot"], also=(F.min("dst_ip").alias("dst_ip"), F.max("end_time").alias("ts")))
    scored = det.recon(features, ports=2, hosts=2)
    alerts = scored.select(F.format_string("%s-%012d", "src_ip", "slot").alias("alert_id"), "src_ip", "dst_ip", F.lit("recon_scan").alias("threat_class"), "confidence", "ts")
    return aq.counts(al.with_severity(al.deduplicate(alerts, 2 * WINDOW)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _Q.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _Q.items() if sql}
