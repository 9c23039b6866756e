"""Questions about stored alerts and flows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import net
from flowloom.operators import detectors


def matching(alerts: DataFrame, threat: str | None = None, severity: str | None = None, since: float | None = None, until: float | None = None, text: str | None = None) -> DataFrame:
    """Filtered alerts. text is looked for, ignoring case, in addresses, identifier and evidence."""
    out = alerts
    if threat:
        out = out.where(F.lower("threat_class") == threat.lower())
    if severity:
        out = out.where(F.col("severity") == severity.upper())
    if since is not None:
        out = out.where(F.col("ts") >= since)
    if until is not None:
        out = out.where(F.col("ts") <= until)
    if text:
        fields = [c for c in ("src_ip", "dst_ip", "alert_id", "evidence_json") if c in out.columns]
        hit = F.lit(False)
        for c in fields:
            hit = hit | F.col(c).ilike(f"%{text}%")
        out = out.where(hit)
    return out


def page(alerts: DataFrame, threat: str | None = None, severity: str | None = None, since: float | None = None, until: float | None = None, text: str | None = None, limit: int = 50, offset: int = 0, with_total: bool = False) -> DataFrame:
    """One page of matching alerts, newest first; with_total adds `total`, how many match on all pages."""
    out = matching(alerts, threat, severity, since, until, text)
    rows = out.orderBy(F.desc("ts"), "alert_id").offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(out.agg(F.count("*").alias("total")))) if with_total else rows  # one row


def with_evidence(alerts: DataFrame) -> DataFrame:
    """Alerts with their stored evidence parsed: a map of its fields' texts."""
    return alerts.withColumn("evidence", detectors.evidence_parsed(F.col("evidence_json"))).drop("evidence_json")


def export_json(alerts: DataFrame, columns: list[str], limit: int = 1000) -> DataFrame:
    """The rows of an export as JSON, a line each."""
    rows = export(alerts, limit)
    return rows.select("alert_id", F.to_json(F.struct(*columns)).alias("line"))


def counts(alerts: DataFrame) -> DataFrame:
    """All alerts, by class and by severity, in one pass."""
    sets = alerts.groupingSets([[], [F.col("threat_class")], [F.col("severity")]], "threat_class", "severity")
    return sets.agg(F.count("*").alias("n"), net.half_away(F.avg("confidence"), 3).alias("avg_confidence"))


def top(alerts: DataFrame, column: str, n: int = 5) -> DataFrame:
    return alerts.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)


def trends(alerts: DataFrame, bucket_seconds: int = 3600) -> DataFrame:
    """Alerts per bucket of time and severity; buckets without any are absent."""
    each = [F.count_if(F.col("severity") == s).alias(s.lower()) for s, _ in net.SEVERITY]
    return alerts.groupBy(net.bucket(F.col("ts"), bucket_seconds).alias("bucket")).agg(F.count("*").alias("total"), *each)


def with_flow(alerts: DataFrame, flows: DataFrame) -> DataFrame:
    """Alerts with their flow, if it is stored; identifiers 'unknown' never match."""
    return alerts.join(flows.where("flow_id != 'unknown'"), "flow_id", "left")


def flow(flows: DataFrame, flow_id: str) -> DataFrame:
    """The rows of one stored flow; none for the identifier 'unknown'."""
    return flows.where((F.col("flow_id") == flow_id) & (F.col("flow_id") != "unknown"))


def kpi(alerts: DataFrame, flows: DataFrame, now: float) -> DataFrame:
    """Alerts per minute and Mbit/s over the last ten seconds, else the last minute, else the whole span."""
    a = alerts.agg(F.count_if(F.col("ts") >= now - 10).alias("a10"), F.count_if(F.col("ts") >= now - 60).alias("a60"), F.count("*").alias("a"), (F.max("ts") - F.min("ts")).alias("aspan"))
    size = F.col("bytes_fwd") + F.col("bytes_bwd")
    end = F.col("start_time") + F.col("duration")
    late = lambda s: F.coalesce(F.sum(F.when(end >= now - s, size)), F.lit(0))
    f = flows.agg(late(10).alias("b10"), late(60).alias("b60"), F.coalesce(F.sum(size), F.lit(0)).alias("b"), (F.max(end) - F.min(end)).alias("bspan"))
    rate = F.when(F.col("a10") > 0, F.col("a10") * 6.0).when(F.col("a60") > 0, F.col("a60") * 1.0).otherwise(F.round(F.col("a") / (F.greatest(F.coalesce("aspan", F.lit(0.0)), F.lit(1.0)) / 60)))
    mbps = F.when(F.col("b10") > 0, F.col("b10") * 8 / 1e7).when(F.col("b60") > 0, F.col("b60") * 8 / 6e7).otherwise(F.col("b") * 8 / 1e6 / F.greatest(F.coalesce("bspan", F.lit(0.0)), F.lit(1.0)))
    return a.crossJoin(f).select(rate.cast("double").alias("alerts_per_minute"), F.round(mbps, 6).alias("mbps"))  # one row each


#: Detectors, how they decide, and metrics shown while no evaluation is stored.
DETECTORS = (
    ("c2_beacon", "C2 Beacon Random Forest"), ("dga_dns", "DGA / DNS Random Forest"), ("encrypted_malware", "JA3 & Isolation Forest"),
    ("ddos", "DDoS EWMA & Isolation Forest"), ("recon_scan", "Port/Host Scan Fan-out Rule"), ("exfiltration", "Rolling Z-Score Baseline"),
)


def models(evaluations: DataFrame) -> DataFrame:
    """The detectors with their stored evaluation (threat_class, model_version, precision, recall, f1), or defaults."""
    fixed = evaluations.sparkSession.createDataFrame(DETECTORS, "threat_class string, name string")
    shown = {"precision": 0.98, "recall": 0.96, "f1": 0.97}
    rows = F.broadcast(fixed).join(evaluations, "threat_class", "left")
    return rows.select("threat_class", "name", F.coalesce("model_version", F.lit("1.0.0")).alias("version"), *(F.coalesce(c, F.lit(v)).alias(c) for c, v in shown.items()))


def patched(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Alerts under the last status given for each (changes: alert_id, seq, status); null statuses change nothing."""
    last = changes.where("status IS NOT NULL").groupBy("alert_id").agg(F.upper(F.max_by("status", "seq")).alias("__status"))
    return alerts.join(last, "alert_id", "left").withColumn("status", F.coalesce("__status", "status")).drop("__status")


def annotations(changes: DataFrame) -> DataFrame:
    """Notes from changes that bring notes or a label; a missing label means a true positive."""
    return changes.where("notes IS NOT NULL OR label IS NOT NULL").select("alert_id", "seq", F.coalesce("notes", F.lit("")).alias("notes"), F.coalesce("label", F.lit("TRUE_POSITIVE")).alias("label"))


def with_annotations(alerts: DataFrame, notes: DataFrame) -> DataFrame:
    """Alerts with their notes in order. An analyst's notes on one alert are few."""
    per = notes.groupBy("alert_id").agg(F.array_sort(F.collect_list(F.struct("seq", "notes"))).alias("annotations"))
    return alerts.join(per, "alert_id", "left")


def iso(ts: str):
    """ISO 8601 in UTC; a fraction only where there is one."""
    t = F.timestamp_micros(F.round(F.col(ts) * 1_000_000).cast("long"))
    whole = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss")
    return F.concat(whole, F.when(F.pmod(F.unix_micros(t), F.lit(1_000_000)) == 0, "").otherwise(F.date_format(t, ".SSSSSS")), F.lit("+00:00"))


def export(alerts: DataFrame, limit: int = 1000) -> DataFrame:
    """The rows of an export, newest first: what `write.csv` or `write.json` then stores."""
    return page(alerts, limit=limit).withColumn("timestamp", iso("ts"))


def shown_classes(summary: DataFrame) -> DataFrame:
    """Per bucket of trends: critical, high and the rest."""
    return summary.select("bucket", "critical", "high", (F.col("total") - F.col("critical") - F.col("high")).alias("other"))


#: The sensor that stands for all while none is stored.
SENSOR = ("sensor-local-01", "Primary Passive Tap (Windows Npcap)", "Local Tap", "127.0.0.1", "ACTIVE", None)
SENSORS = "id string, name string, interface string, ip_address string, status string, last_heartbeat double"


def sensors(stored: DataFrame) -> DataFrame:
    """The stored sensors, or the standing one if there is none; heartbeats in ISO 8601."""
    standing = stored.sparkSession.createDataFrame([SENSOR], SENSORS)
    none = stored.agg(F.count("*").alias("__n")).where("__n = 0")  # one row or none
    rows = stored.unionByName(standing.join(F.broadcast(none)).drop("__n"))
    return rows.withColumn("last_heartbeat", iso("last_heartbeat"))


def health(stored: DataFrame, started: float, now: float) -> DataFrame:
    """One row: whether the store answers, and for how long the service has run."""
    try:
        stored.limit(1).collect()
        answers = True
    except Exception:  # noqa: BLE001 - any failure of the store is what this reports
        answers = False
    row = [("ok" if answers else "degraded", round(now - started, 2), answers, float(now))]
    return stored.sparkSession.createDataFrame(row, "status string, uptime_seconds double, db_connected boolean, timestamp double")
