"""Packets made up by rule: each row follows from its number, so any part of any size can be made on any task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Six kinds of traffic in turn (SQL expressions of the row number i). Lengths count headers and payload.
ATTACKS = (
    {"label": "'ddos'", "src_ip": "concat('10.100.', i % 250, '.', i * 3 % 250)", "dst_ip": "'192.168.1.50'", "src_port": "1024 + i % 60000", "dst_port": "80", "protocol": "6", "tcp_flags": "2", "length": "40", "dns_qname": "NULL"},
    {"label": "'recon_scan'", "src_ip": "'192.168.1.200'", "dst_ip": "'10.0.0.10'", "src_port": "40000 + i % 20000", "dst_port": "1 + i % 1000", "protocol": "6", "tcp_flags": "2", "length": "40", "dns_qname": "NULL"},
    {"label": "'c2_beacon'", "src_ip": "'192.168.1.105'", "dst_ip": "'198.51.100.77'", "src_port": "49500", "dst_port": "443", "protocol": "6", "tcp_flags": "24", "length": "54", "dns_qname": "NULL"},
    {"label": "'exfiltration'", "src_ip": "'192.168.1.105'", "dst_ip": "'203.0.113.88'", "src_port": "49501", "dst_port": "8080", "protocol": "6", "tcp_flags": "24", "length": "720", "dns_qname": "NULL"},
    {"label": "'dga_dns'", "src_ip": "'192.168.1.150'", "dst_ip": "'8.8.8.8'", "src_port": "53000 + i % 1000", "dst_port": "53", "protocol": "17", "tcp_flags": "0", "length": "45 + length(concat('dga-probe-', i % 500, '-xq9zk7.net'))", "dns_qname": "concat('dga-probe-', i % 500, '-xq9zk7.net')"},
    {"label": "'encrypted_malware'", "src_ip": "'192.168.1.210'", "dst_ip": "'198.51.100.99'", "src_port": "49502", "dst_port": "443", "protocol": "6", "tcp_flags": "24", "length": "160", "dns_qname": "NULL"},
)
#: Harmless questions, encrypted and plain requests in turn, from 15 clients.
HARMLESS = (
    {"label": "'benign'", "src_ip": "concat('192.168.1.', 10 + i % 15)", "dst_ip": "'8.8.8.8'", "src_port": "50000 + i % 5000", "dst_port": "53", "protocol": "17", "tcp_flags": "0", "length": "60", "dns_qname": "CASE i % 5 WHEN 0 THEN 'google.com' WHEN 1 THEN 'github.com' WHEN 2 THEN 'microsoft.com' WHEN 3 THEN 'cloudflare.com' ELSE 'wikipedia.org' END"},
    {"label": "'benign'", "src_ip": "concat('192.168.1.', 10 + i % 15)", "dst_ip": "'142.250.190.46'", "src_port": "51000 + i % 5000", "dst_port": "443", "protocol": "6", "tcp_flags": "24", "length": "179", "dns_qname": "NULL"},
    {"label": "'benign'", "src_ip": "concat('192.168.1.', 10 + i % 15)", "dst_ip": "'93.184.216.34'", "src_port": "52000 + i % 5000", "dst_port": "80", "protocol": "6", "tcp_flags": "24", "length": "113", "dns_qname": "NULL"},
)
_TYPES = {"src_port": "INT", "dst_port": "INT", "protocol": "INT", "tcp_flags": "INT", "length": "INT"}


def select_sql(kinds: tuple[dict[str, str], ...], numbers: str, start: float = 1_700_000_000.0, gap: float = 0.001) -> str:
    """A SELECT over a table of numbers i that Spark and DuckDB read alike."""
    cases = []
    for c in kinds[0]:
        case = f"CASE i % {len(kinds)} " + " ".join(f"WHEN {k} THEN {kind[c]}" for k, kind in enumerate(kinds)) + " END"
        cases.append(f"CAST({case} AS {_TYPES[c]}) AS {c}" if c in _TYPES else f"{case} AS {c}")
    return f"SELECT i AS seq, CAST({start} AS DOUBLE) + i * CAST({gap} AS DOUBLE) AS ts, {', '.join(cases)} FROM {numbers}"


def packets(spark: SparkSession, n: int, kinds: tuple[dict[str, str], ...] = ATTACKS, start: float = 1_700_000_000.0, gap: float = 0.001) -> DataFrame:
    """n packets, `gap` seconds apart, the kinds taking turns."""
    return spark.sql(select_sql(kinds, "{numbers}", start, gap), numbers=spark.range(n).withColumnRenamed("id", "i"))


def as_read(rows: DataFrame) -> DataFrame:
    """The rows as a source would give them: made once each, whatever reads their columns how often."""
    return rows.mapInArrow(lambda batches: batches, rows.schema)


def client_hello(version: Column, ciphers: Column, curves: Column, formats: Column, sni: Column, more: Column) -> Column:
    """The bytes of a TLS record with a client's first message: extensions for the name (unless null), curves and formats, then empty ones of the types in `more`."""
    wide = lambda x, digits: F.lpad(F.hex(x.cast("long")), digits, "0")
    half = lambda text: F.floor(F.length(text) / 2)
    joined = lambda xs, digits: F.array_join(F.transform(xs, lambda x: wide(x, digits)), "")
    counted = lambda text, digits: F.concat(wide(half(text), digits), text)
    extension = lambda kind, body: F.concat(F.lit(f"{kind:04X}"), counted(body, 4))
    name = F.when(sni.isNotNull(), extension(0, counted(F.concat(F.lit("00"), counted(F.hex(F.encode(sni, "utf-8")), 4)), 4))).otherwise("")
    rest = F.array_join(F.transform(more, lambda x: F.concat(wide(x, 4), F.lit("0000"))), "")
    extensions = F.concat(name, extension(10, counted(joined(curves, 4), 4)), extension(11, counted(joined(formats, 2), 2)), rest)
    body = F.concat(wide(version, 4), F.lit("AB" * 32 + "00"), counted(joined(ciphers, 4), 4), F.lit("0100"), counted(extensions, 4))
    return F.unhex(F.concat(F.lit("160301"), counted(F.concat(F.lit("01"), counted(body, 6)), 4)))


def _wide(x: Column, size: int) -> Column:
    """An integer as `size` bytes, in hexadecimal."""
    return F.lpad(F.hex(x.cast("long")), 2 * size, "0")


def address(ip: Column) -> Column:
    """An IPv4 address as four bytes, in hexadecimal. A number past 255, which made-up addresses may have, is carried into the one before it."""
    whole = lambda a, x: a * 256 + x.cast("long")
    return _wide(F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), whole), 4)


def dns_question(name: Column, kind: Column) -> Column:
    """The bytes of a DNS message with one question."""
    label = lambda x: F.concat(_wide(F.length(x), 1), F.hex(F.encode(x, "utf-8")))
    labels = F.array_join(F.transform(F.split(name, r"\."), label), "")
    return F.unhex(F.concat(F.lit("000701000001000000000000"), labels, F.lit("00"), _wide(kind, 2), F.lit("0001")))


def frame(src_ip: Column, dst_ip: Column, src_port: Column, dst_port: Column, protocol: Column, tcp_flags: Column, payload: Column, ethernet: Column) -> Column:
    """The bytes of an IPv4 packet with TCP (6) or UDP (17) and a payload, behind an Ethernet header or bare. Checksums are 0."""
    body, size = F.hex(payload), F.length(payload)
    tcp = F.concat(F.lit("00" * 8 + "50"), _wide(tcp_flags, 1), F.lit("00" * 6))
    udp = F.concat(_wide(size + 8, 2), F.lit("0000"))
    inner = F.concat(_wide(src_port, 2), _wide(dst_port, 2), F.when(protocol == 6, tcp).otherwise(udp), body)
    ip = F.concat(F.lit("4500"), _wide(F.length(inner) / 2 + 20, 2), F.lit("0000000040"), _wide(protocol, 1), F.lit("0000"), address(src_ip), address(dst_ip))
    return F.unhex(F.concat(F.when(ethernet, "00" * 12 + "0800").otherwise(""), ip, inner))


def export_set(number: Column, body: Column) -> Column:
    """A set of a flow export in hexadecimal: its number, its length and its body (hexadecimal), not padded."""
    return F.concat(_wide(number, 2), _wide(F.length(body) / 2 + 4, 2), body)


def export_template(number: Column, fields: tuple[tuple[int, int], ...]) -> Column:
    """A template in hexadecimal: its number and its fields (number and size)."""
    return F.concat(_wide(number, 2), F.lit("".join(f"{x:04X}" for x in (len(fields), *(x for f in fields for x in f)))))


def export(version: Column, seconds: Column, seq: Column, source: Column, sets: Column) -> Column:
    """The bytes of a NetFlow v9 or IPFIX datagram with these sets (hexadecimal)."""
    nine = F.concat(F.lit("0009" + "0001" + "00" * 4), _wide(seconds, 4), _wide(seq, 4), _wide(source, 4))
    ten = F.concat(F.lit("000A"), _wide(F.length(sets) / 2 + 16, 2), _wide(seconds, 4), _wide(seq, 4), _wide(source, 4))
    return F.unhex(F.concat(F.when(version == 9, nine).otherwise(ten), sets))
