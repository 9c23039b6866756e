"""From candidates to alerts: floor, suppression of repeats, severity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions import net

FLOOR = 0.25


def deduplicate(candidates: DataFrame, window: float = 30.0) -> DataFrame:
    """Candidates at or above the floor that come `window` seconds or more after the last of their (source, destination, class).

    Every candidate restarts the window, also a suppressed one, so only the gap to the row before it matters.
    """
    order = Window.partitionBy("src_ip", "dst_ip", F.lower("threat_class")).orderBy("ts", "alert_id")
    kept = candidates.where(F.col("confidence") >= FLOOR).withColumn("__gap", F.col("ts") - F.lag("ts").over(order))
    return kept.where(F.col("__gap").isNull() | (F.col("__gap") >= window)).drop("__gap")


def with_severity(alerts: DataFrame) -> DataFrame:
    score = net.severity_score(F.col("confidence"), F.col("threat_class"))
    return alerts.withColumns({"severity": net.severity_label(score), "severity_score": F.round(F.round(score, 6), 4)})


#: The order in which candidates of one event come.
CLASSES = ("ddos", "c2_beacon", "recon_scan", "exfiltration", "dga_dns", "encrypted_malware")


def fan_out(scores: DataFrame, keep: list[str], floor: float = FLOOR) -> DataFrame:
    """One candidate per event and class from columns named after the classes, if at or above the floor. No exchange."""
    each = [F.struct(F.lit(i).alias("rank"), F.lit(c).alias("threat_class"), F.col(c).cast("double").alias("confidence")) for i, c in enumerate(CLASSES) if c in scores.columns]
    rows = scores.select(*keep, F.inline(F.array(*each)))
    return rows.where(F.col("confidence") >= floor)


def completed(candidates: DataFrame, now: float) -> DataFrame:
    """Candidates with every field of an alert: defaults for what is missing, the flow's end or `now` for times not positive, evidence as JSON.

    Identifiers follow from key and time, so that a rerun gives the same ones.
    """
    has = set(candidates.columns)
    text = lambda c, d: F.coalesce(F.col(c).cast("string"), F.lit(d)) if c in has else F.lit(d)
    port = lambda c: F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in has else F.lit(0)
    times = [F.when(F.col(c) > 0, F.col(c).cast("double")) for c in ("ts", "end_time") if c in has]
    rows = candidates.withColumns({
        "src_ip": text("src_ip", "0.0.0.0"), "dst_ip": text("dst_ip", "0.0.0.0"), "src_port": port("src_port"), "dst_port": port("dst_port"), "protocol": port("protocol"),
        "flow_id": text("flow_id", "unknown"), "threat_class": text("threat_class", "unknown"), "ts": F.coalesce(*times, F.lit(float(now))),
    })
    key = F.concat_ws("|", "src_ip", "dst_ip", F.lower("threat_class"), "flow_id", F.round(F.col("ts") * 1_000_000).cast("long").cast("string"))
    if "evidence" in has:
        rows = rows.withColumn("evidence_json", F.to_json("evidence")).drop("evidence")
    return rows.withColumn("alert_id", F.concat(F.lit("alert-"), F.substring(F.sha2(key, 256), 1, 12))).withColumn("status", F.lit("NEW"))


def priority(rate: str = "packets_per_sec", scans: str = "scan_rate"):
    """1 for events that go first: many packets or flows a second."""
    return F.when((F.col(rate) > 200) | (F.col(scans) > 10), 1).otherwise(0)
