"""Rule scores of feature vectors: each adds `confidence` in [0, 1], rounded to four places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import net


def _scored(df: DataFrame, total: Column) -> DataFrame:
    held = df.withColumn("confidence", F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)))
    return held.withColumn("confidence", net.half_away(F.col("confidence"), 4))


def ddos(df: DataFrame, pps: float = 500.0, bps: float = 1e6, syn_ack: float = 5.0, entropy: float = 4.0, sources: int = 20, half_open: int = 20) -> DataFrame:
    """Packet rate (or its running mean `ewma`, if there), byte rate, unanswered handshakes and spread of sources."""
    rate = F.greatest("packets_per_sec", "ewma") if "ewma" in df.columns else F.col("packets_per_sec")
    col = lambda c: F.col(c) if c in df.columns else F.lit(0.0)
    total = (
        F.when(rate >= pps, F.least(0.4 * rate / pps / 2, F.lit(0.4))).otherwise(0.0)
        + F.when(F.col("bytes_per_sec") >= bps, F.least(0.3 * F.col("bytes_per_sec") / bps / 2, F.lit(0.3))).otherwise(0.0)
        + F.when(col("syn_ack_ratio") >= syn_ack, 0.25).otherwise(0.0)
        + F.when((F.col("src_ip_entropy") >= entropy) & (F.col("unique_src_count") >= sources), 0.25).otherwise(0.0)
        + F.when(col("half_open_count") >= half_open, 0.2).otherwise(0.0)
    )
    return _scored(df, total)


def recon(df: DataFrame, ports: int = 15, hosts: int = 10, rate: float = 5.0, lone: float = 0.7, run: float = 0.5) -> DataFrame:
    """Vertical and horizontal scans, helped by rate, unanswered flows and runs of ports."""
    p, h, r = F.col("unique_dst_ports"), F.col("unique_dst_hosts"), F.col("scan_rate")
    wide = lambda n, least: F.when(n >= least, F.least(0.4 + 0.2 * (n / least - 1), F.lit(0.8))).otherwise(0.0)
    total = (
        F.greatest(wide(p, ports), wide(h, hosts))
        + F.when((r >= rate) & ((p > 3) | (h > 3)), F.least(0.15 * r / rate, F.lit(0.25))).otherwise(0.0)
        + F.when((F.col("syn_no_completion_ratio") >= lone) & ((p > 5) | (h > 5)), 0.2 * F.col("syn_no_completion_ratio")).otherwise(0.0)
        + F.when((F.col("port_sequence_score") >= run) & (p >= 5), 0.15 * F.col("port_sequence_score")).otherwise(0.0)
    )
    return _scored(df, total)


def exfiltration(df: DataFrame) -> DataFrame:
    """Unusual outbound volume, ratio, hour and destination."""
    z, r = F.col("outbound_volume_zscore"), F.col("outbound_inbound_ratio")
    z = F.when(F.isnan(z), 0.0).when(z > 50, 10.0).otherwise(z)
    d = F.col("duration_bytes_ratio")
    total = (
        F.when(z >= 3, F.least(0.4 + 0.08 * (z - 3), F.lit(0.8))).otherwise(0.0)
        + F.when(r >= 5, F.least(0.25 * r / 5, F.lit(0.4))).otherwise(0.0)
        + F.when((F.col("off_hours_flag") == 1) & ((z >= 2) | (r >= 3)), 0.2).otherwise(0.0)
        + F.when((F.col("destination_novel") == 1) & ((z >= 2) | (r >= 3)), 0.15).otherwise(0.0)
        + F.when((d > 0) & (d < 0.001) & (r >= 2), 0.15).otherwise(0.0)
    )
    return _scored(df, total)


def beacon_boost(df: DataFrame) -> Column:
    """What regularity adds to a beacon model's probability."""
    per, cv, mean = F.col("periodicity_score"), F.col("iat_cv"), F.col("iat_mean")
    regular = (per >= 0.4) | (cv <= 0.2)
    return (
        F.when(per >= 0.5, 0.2).otherwise(0.0) + F.when((cv <= 0.15) & (mean >= 1), 0.2).otherwise(0.0)
        + F.when((F.col("dst_cardinality") == 1) & regular, 0.1).otherwise(0.0) + F.when((F.col("byte_size_cv") <= 0.1) & regular, 0.1).otherwise(0.0)
    )


def beacon(df: DataFrame, probability: Column) -> DataFrame:
    """A model's probability fused with the rules; irregular traffic is held at 0.25."""
    fused = F.greatest(probability, 0.7 * probability + 0.3 * beacon_boost(df))
    return _scored(df, F.when((F.col("periodicity_score") < 0.15) & (F.col("iat_cv") > 0.5), F.least(fused, F.lit(0.25))).otherwise(fused))


def fused_ddos(df: DataFrame, decision: Column) -> DataFrame:
    """Rule score fused with an isolation forest's decision; without a rule the forest alone stays at 0.2 unless it is sure."""
    ruled = ddos(df).withColumn("__d", decision)
    d, far, rule = F.col("__d"), F.abs("__d"), F.col("confidence")
    odd = F.when(d >= 0, F.greatest(F.lit(0.0), 0.1 - 0.5 * d)).when(d >= -0.08, 0.1 + far / 0.08 * 0.15).otherwise(F.least(F.lit(0.95), 0.5 + 1.5 * far))
    both = F.when(rule > 0, F.greatest(rule, 0.7 * rule + 0.3 * odd)).when(odd < 0.5, F.least(F.lit(0.2), odd)).otherwise(odd)
    return _scored(ruled, both).drop("__d")


def _or(df: DataFrame, name: str, default: float) -> Column:
    return F.coalesce(F.col(name).cast("double"), F.lit(default)) if name in df.columns else F.lit(default)


def name_vector(df: DataFrame) -> DataFrame:
    """entropy, ngram_score, digit_ratio, consonant_ratio and label_length of single names, or of a group's means."""
    if "entropy" in df.columns:
        picked = {c: _or(df, c, 0.0) for c in ("entropy", "ngram_score", "digit_ratio", "consonant_ratio", "label_length")}
    else:
        means = (("entropy", "mean_entropy", 0.0), ("ngram_score", "mean_ngram_score", -15.0), ("digit_ratio", "mean_digit_ratio", 0.0), ("label_length", "mean_label_length", 10.0))
        picked = {c: _or(df, m, default) for c, m, default in means} | {"consonant_ratio": F.lit(0.6)}
    return df.withColumns(picked)


def dns(df: DataFrame, probability: Column) -> DataFrame:
    """A name model's probability fused with rules on names and on the questions' types and spread.

    df has the columns of name_vector; txt_null_ratio and unique_subdomains_per_apex count as 0 where absent.
    """
    e, g, digits = F.col("entropy"), F.col("ngram_score"), F.col("digit_ratio")
    txt, subs = _or(df, "txt_null_ratio", 0.0), _or(df, "unique_subdomains_per_apex", 0.0)
    boost = (
        F.when(e >= 3.2, 0.25).otherwise(0.0) + F.when(g <= -16, 0.25).otherwise(0.0) + F.when(digits >= 0.3, 0.2).otherwise(0.0)
        + F.when(txt >= 0.5, 0.35).otherwise(0.0) + F.when(subs >= 10, 0.35).otherwise(0.0)
    )
    fused = F.greatest(probability, 0.6 * probability + 0.4 * boost)
    plain = (e < 2.5) & (g > -14) & (txt == 0) & (subs < 2)
    return _scored(df, F.when(plain, F.least(fused, F.lit(0.2))).otherwise(fused))


def handshake(df: DataFrame, decision: Column) -> DataFrame:
    """Known fingerprints, bare handshakes, and an isolation forest's decision where there is anything to judge."""
    ciphers, extensions = F.col("cipher_suite_count"), F.col("extension_count")
    known = F.when(F.col("denylist_match") != "", 0.98).otherwise(0.0)
    bare = F.when((ciphers > 0) & (ciphers <= 2) & (extensions <= 1), 0.7).otherwise(0.0)
    rules = F.greatest(F.coalesce(known, F.lit(0.0)), bare)
    rows = df.withColumns({"__r": rules, "__d": decision})
    r, d = F.col("__r"), F.col("__d")
    odd = F.least(F.lit(0.85), 0.45 + 1.5 * F.abs(d))
    judged = F.when(d < 0, F.greatest(r, odd)).when(r == 0, F.greatest(F.lit(0.0), 0.1 - 0.4 * d)).otherwise(r)
    return _scored(rows, F.when((ciphers > 0) | (F.col("pkt_size_mean") > 0), judged).otherwise(r)).drop("__r", "__d")


def evidence(fields: list[str], triggers: dict[str, Column]) -> Column:
    """What a score rests on: its features rounded to four places, and the texts of the rules that hold.

    triggers maps a format with one place ('rate {:.1f}' as '%.1f') to (condition, value) given as a struct column
    with fields `holds` and `value`.
    """
    places = {"%.0f": 0, "%.1f": 1, "%.2f": 2}
    shown = lambda text, v: F.format_string(text, net.half_even(v, next(n for f, n in places.items() if f in text)))
    said = F.filter(F.array(*(F.when(c["holds"], shown(text, c["value"])) for text, c in triggers.items())), lambda t: t.isNotNull())
    return F.struct(*(net.half_even(F.col(f), 4).alias(f) for f in fields), said.alias("triggers"))


def evidence_json(evidence: Column) -> Column:
    """Evidence as stored with an alert and searched in."""
    return F.to_json(evidence)


def evidence_parsed(text: Column) -> Column:
    """Stored evidence as a map of its fields' JSON texts; empty for null and for anything but an object."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def trigger(holds: Column, value: Column) -> Column:
    return F.struct(holds.alias("holds"), value.alias("value"))


def recon_evidence() -> Column:
    return evidence(
        ["unique_dst_ports", "unique_dst_hosts", "syn_no_completion_ratio", "port_sequence_score", "scan_rate"],
        {
            "%.0f ports on one target": trigger(F.col("unique_dst_ports") >= 15, F.col("unique_dst_ports")),
            "%.0f hosts": trigger(F.col("unique_dst_hosts") >= 10, F.col("unique_dst_hosts")),
            "%.1f flows a second": trigger(F.col("scan_rate") >= 5, F.col("scan_rate")),
            "%.1f percent unanswered": trigger(F.col("syn_no_completion_ratio") >= 0.7, 100 * F.col("syn_no_completion_ratio")),
            "%.1f percent of ports in a row": trigger(F.col("port_sequence_score") >= 0.5, 100 * F.col("port_sequence_score")),
        },
    )


def ddos_evidence(pps: float = 500.0, bps: float = 1e6) -> Column:
    return evidence(
        ["packets_per_sec", "bytes_per_sec", "unique_src_count", "src_ip_entropy"],
        {
            "%.1f packets a second": trigger(F.col("packets_per_sec") >= pps, F.col("packets_per_sec")),
            "%.1f bytes a second": trigger(F.col("bytes_per_sec") >= bps, F.col("bytes_per_sec")),
            "sources spread over %.2f bits": trigger((F.col("src_ip_entropy") >= 4) & (F.col("unique_src_count") >= 20), F.col("src_ip_entropy")),
        },
    )


def beacon_evidence() -> Column:
    return evidence(
        ["iat_mean", "iat_cv", "periodicity_score", "dst_cardinality", "byte_size_cv"],
        {
            "periodicity %.2f": trigger(F.col("periodicity_score") >= 0.5, F.col("periodicity_score")),
            "gaps vary by %.2f of their mean": trigger((F.col("iat_cv") <= 0.15) & (F.col("iat_mean") >= 1), F.col("iat_cv")),
            "%.0f peer": trigger(F.col("dst_cardinality") == 1, F.col("dst_cardinality")),
            "sizes vary by %.2f of their mean": trigger(F.col("byte_size_cv") <= 0.1, F.col("byte_size_cv")),
        },
    )


def exfiltration_evidence() -> Column:
    return evidence(
        ["outbound_volume_zscore", "outbound_inbound_ratio", "duration_bytes_ratio", "off_hours_flag", "destination_novel"],
        {
            "outbound volume %.1f deviations above the source's mean": trigger(F.col("outbound_volume_zscore") >= 3, F.col("outbound_volume_zscore")),
            "%.1f times as much out as in": trigger(F.col("outbound_inbound_ratio") >= 5, F.col("outbound_inbound_ratio")),
            "outside working hours (%.0f)": trigger(F.col("off_hours_flag") == 1, F.col("off_hours_flag")),
            "destination not seen before (%.0f)": trigger(F.col("destination_novel") == 1, F.col("destination_novel")),
        },
    )


def dns_evidence() -> Column:
    """On the columns of name_vector."""
    return evidence(
        ["entropy", "ngram_score", "digit_ratio", "label_length"],
        {
            "entropy %.2f bits": trigger(F.col("entropy") >= 3.2, F.col("entropy")),
            "n-gram score %.2f": trigger(F.col("ngram_score") <= -16, F.col("ngram_score")),
            "%.1f percent digits": trigger(F.col("digit_ratio") >= 0.3, 100 * F.col("digit_ratio")),
        },
    )


def handshake_evidence() -> Column:
    few = (F.col("cipher_suite_count") > 0) & (F.col("cipher_suite_count") <= 2) & (F.col("extension_count") <= 1)
    return evidence(
        ["cipher_suite_count", "extension_count", "pkt_size_mean", "pkt_ipt_mean"],
        {
            "known fingerprint (%.0f)": trigger(F.col("denylist_match") != "", F.lit(1)),
            "only %.0f cipher suites": trigger(few, F.col("cipher_suite_count")),
        },
    )
