"""Traffic views over the star-schema tables, so that every operator runs at any scale.

The same SQL serves Spark and DuckDB; only the spelling of a few functions differs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_TEMPLATES = {
    "packets": """
WITH e AS (SELECT event_id AS seq, {EPOCH} AS ts, user_id, event_type, value, CAST({JSON} AS INT) AS k FROM events),
f AS (SELECT seq, ts, concat('10.0.', CAST(CAST(floor(user_id/256.0) AS INT) AS {STR}), '.', CAST(user_id % 256 AS {STR})) AS c_ip,
  concat('198.51.100.', CAST(k % 5 AS {STR})) AS s_ip, CAST(40000 + user_id % 20000 AS INT) AS c_port,
  CASE k % 5 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 53 WHEN 3 THEN 22 ELSE 8080 END AS s_port,
  CASE WHEN k % 5 = 2 THEN 17 ELSE 6 END AS protocol, CAST(40 + floor(value) AS INT) AS length,
  CASE WHEN k % 5 = 2 THEN 0 WHEN event_type='signup' THEN 2 WHEN event_type='click' THEN 16 WHEN event_type='view' THEN 24
       WHEN event_type='purchase' THEN 18 ELSE 4 END AS tcp_flags FROM e)
SELECT seq, ts, CASE WHEN seq % 3 = 2 THEN s_ip ELSE c_ip END AS src_ip, CASE WHEN seq % 3 = 2 THEN c_ip ELSE s_ip END AS dst_ip,
  CASE WHEN seq % 3 = 2 THEN s_port ELSE c_port END AS src_port, CASE WHEN seq % 3 = 2 THEN c_port ELSE s_port END AS dst_port,
  protocol, length, tcp_flags FROM f""",
    "flows": """
SELECT o_orderkey AS seq, concat('10.1.', CAST(CAST(floor(o_custkey/256.0) AS INT) AS {STR}), '.', CAST(o_custkey % 256 AS {STR})) AS src_ip,
  concat('203.0.113.', CAST(o_orderkey % 97 AS {STR})) AS dst_ip, CAST(1 + o_orderkey % 200 AS INT) AS dst_port,
  CASE WHEN o_orderkey % 5 = 0 THEN 17 ELSE 6 END AS protocol,
  1 + o_orderkey % 9 AS packets_fwd, o_orderkey % 4 AS packets_bwd,
  CAST(floor(o_totalprice) AS BIGINT) AS bytes_fwd, CAST((o_orderkey % 7) * 1000 AS BIGINT) AS bytes_bwd,
  {OEPOCH} + (o_orderkey * 37) % 86400 AS start_time, (o_orderkey % 50) / 10.0{DBL} AS duration FROM orders""",
    "alerts": """
SELECT concat('alert-', CAST(o_orderkey AS {STR})) AS alert_id, {OEPOCH} + (o_orderkey * 37) % 86400 AS ts,
  concat('flow-', CAST(o_orderkey % 1000 AS {STR})) AS flow_id,
  CASE o_orderkey % 6 WHEN 0 THEN 'ddos' WHEN 1 THEN 'c2_beacon' WHEN 2 THEN 'dga_dns' WHEN 3 THEN 'encrypted_malware' WHEN 4 THEN 'recon_scan' ELSE 'exfiltration' END AS threat_class,
  ((o_orderkey * 37) % 1000) / 1000.0{DBL} AS confidence,
  concat('10.1.0.', CAST(o_custkey % 50 AS {STR})) AS src_ip, concat('203.0.113.', CAST(o_orderkey % 20 AS {STR})) AS dst_ip FROM orders""",
    "dns_queries": """
SELECT page_id AS seq, {HOST} AS qname, CASE page_id % 4 WHEN 0 THEN 'TXT' WHEN 1 THEN '16' ELSE 'A' END AS qtype,
  concat('10.2.0.', CAST(page_id % 7 AS {STR})) AS src_ip, page_id * 0.5{DBL} AS ts FROM pages""",
}
_SOURCE = {"packets": "events", "flows": "orders", "alerts": "orders", "dns_queries": "pages"}
_SPARK = {
    "{EPOCH}": "unix_micros(CAST(ts AS TIMESTAMP))/1e6", "{JSON}": "get_json_object(props,'$.k')", "{STR}": "STRING", "{DBL}": "D",
    "{OEPOCH}": "unix_micros(CAST(o_orderdate AS TIMESTAMP))/1e6", "{HOST}": "parse_url(url,'HOST')",
}
_DUCK = {
    "{EPOCH}": "epoch_us(ts)/1e6", "{JSON}": "json_extract_string(props,'$.k')", "{STR}": "VARCHAR", "{DBL}": "::DOUBLE",
    "{OEPOCH}": "epoch_us(o_orderdate)/1e6", "{HOST}": "regexp_extract(url,'^[a-z]+://([^/:?#]+)',1)",
}


def _spelled(name: str, words: dict[str, str]) -> str:
    sql = _TEMPLATES[name]
    for k, v in words.items():
        sql = sql.replace(k, v)
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of packets, flows, alerts and dns_queries."""
    table = _SOURCE[name]
    source = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql(_spelled(name, _SPARK).replace(f"FROM {table}", "FROM {source}"), source=source)


def oracle(name: str) -> str:
    """The same view for DuckDB, to stand in a WITH clause."""
    return f"{name} AS ({_spelled(name, _DUCK)})"
