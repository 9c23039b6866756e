"""Column expressions on packets, flows, names and handshakes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

FIN, SYN, RST, PSH, ACK, URG = 1, 2, 4, 8, 16, 32
TCP, UDP = 6, 17
#: Windows shorter than this count as this long, in seconds.
SHORTEST = 1e-9
#: Weight of each threat class in the severity score, and the score from which a label holds.
CLASS_WEIGHT = {"exfiltration": 1.0, "c2_beacon": 0.95, "encrypted_malware": 0.9, "ddos": 0.9, "dga_dns": 0.85, "recon_scan": 0.65}
OTHER_WEIGHT = 0.75
SEVERITY = (("CRITICAL", 0.75), ("HIGH", 0.55), ("MEDIUM", 0.35), ("LOW", 0.0))
#: Fingerprints of handshakes that examples in threat reports call malicious.
BAD_JA3 = {
    "e7d705a3286e19ea42f587b344ee6865": "EXAMPLE: Metasploit Meterpreter reverse_https",
    "6734f37431670b3ab4292b8f60f29984": "EXAMPLE: Cobalt Strike default profile",
    "72a589da586844d7f0818ce684948eea": "EXAMPLE: Emotet C2 communication",
    "a0e9f5d64349fb13191bc781f81f42e1": "EXAMPLE: TrickBot loader variant",
    "4d7a28d6f2263ed61de88ca66eb01134": "EXAMPLE: Dridex banking trojan",
}
#: Types of DNS questions that carry data.
DATA_QTYPES = ("TXT", "NULL", "CNAME", "MX", "10", "16", "255")


def safe_ratio(n: Column, d: Column, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(n, d), F.lit(default))


def flow_key() -> list[Column]:
    """ip_a, port_a, ip_b, port_b, protocol and is_forward: the endpoint that is smaller as (text, port) comes first."""
    src, dst = F.struct("src_ip", "src_port"), F.struct(F.col("dst_ip").alias("src_ip"), F.col("dst_port").alias("src_port"))
    fwd = src <= dst
    pick = lambda a, b: F.when(fwd, F.col(a)).otherwise(F.col(b))
    return [pick("src_ip", "dst_ip").alias("ip_a"), pick("src_port", "dst_port").alias("port_a"), pick("dst_ip", "src_ip").alias("ip_b"), pick("dst_port", "src_port").alias("port_b"), F.col("protocol"), fwd.alias("is_forward")]


def flow_id() -> Column:
    """16 hex digits of the SHA-256 of the key's text."""
    return F.substring(F.sha2(F.format_string("%s:%d-%s:%d-%d", "ip_a", "port_a", "ip_b", "port_b", "protocol"), 256), 1, 16)


def has_flags(flags: Column, mask: int) -> Column:
    return flags.bitwiseAND(mask) != 0


def label_of(qname: Column) -> Column:
    """The label that carries the name: second to last, or third to last if the second to last has at most three letters and there are three."""
    parts = F.split(F.lower(F.rtrim(qname, F.lit("."))), r"\.")
    n = F.size(parts)
    return F.when(n < 2, F.element_at(parts, 1)).when((n >= 3) & (F.length(F.try_element_at(parts, F.lit(-2))) <= 3), F.try_element_at(parts, F.lit(-3))).otherwise(F.try_element_at(parts, F.lit(-2)))


def apex_of(qname: Column) -> Column:
    """The last two labels of a name of three or more, else null."""
    parts = F.split(F.lower(F.rtrim(qname, F.lit("."))), r"\.")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, -2, 2), "."))


def subdomain_of(qname: Column) -> Column:
    """What stands before the last two labels, else null."""
    parts = F.split(F.lower(F.rtrim(qname, F.lit("."))), r"\.")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 2), "."))


def entropy_of_text(text: Column) -> Column:
    """Shannon entropy, in bits, of a text's characters."""
    n = F.length(text).cast("double")
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))
    return F.when(n > 1, bits).otherwise(0.0)


def ratio_of(text: Column, inside: str) -> Column:
    """The share of characters in a class."""
    return safe_ratio(F.length(F.regexp_replace(text, f"[^{inside}]", "")).cast("double"), F.length(text).cast("double"))


def carries_data(qtype: Column) -> Column:
    return F.coalesce(F.upper(qtype.cast("string")).isin(*DATA_QTYPES), F.lit(False))


def without_grease(values: Column) -> Column:
    """Handshake lists without the reserved values 0A0A, 1A1A, ... FAFA."""
    return F.filter(values, lambda c: (c.bitwiseAND(0x0F0F) != 0x0A0A) | (F.shiftright(c, 8) != c.bitwiseAND(0xFF)))


def ja3_text(version: Column, ciphers: Column, extensions: Column, curves: Column, formats: Column) -> Column:
    dashed = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), "-")
    return F.concat_ws(",", version.cast("string"), dashed(without_grease(ciphers)), dashed(without_grease(extensions)), dashed(without_grease(curves)), dashed(formats))


def class_weight(threat: Column, weights: Mapping[str, float] = CLASS_WEIGHT) -> Column:
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.lower(threat)), F.lit(OTHER_WEIGHT))


def severity_score(confidence: Column, threat: Column) -> Column:
    return confidence * class_weight(threat)


def severity_label(score: Column) -> Column:
    out = None
    for name, least in SEVERITY[:-1]:
        out = F.when(score >= least, name) if out is None else out.when(score >= least, name)
    return out.otherwise(SEVERITY[-1][0])


def off_hours(ts: Column) -> Column:
    """1 outside [9, 17) UTC, 0 for times that aren't positive."""
    hour = F.hour(F.timestamp_seconds(ts))
    return F.when(ts > 0, ((hour < 9) | (hour >= 17)).cast("int")).otherwise(0)


def bucket(ts: Column, seconds: float) -> Column:
    return (F.floor(ts / seconds) * seconds).cast("long")


def half_even(value: Column, places: int) -> Column:
    """Rounded to so many places; a value halfway between two goes to the even one (as its shortest decimal form reads)."""
    return F.bround(value.cast("double"), places)


def half_away(value: Column, places: int) -> Column:
    """A double rounded to so many places as SQL's round does it: the number times 10**places, halves away from zero, divided again.

    Spark's own round goes by a number's shortest decimal form, and so takes the other side of some numbers next to a half.
    """
    scaled = value * 10.0**places
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**places).otherwise(value)
