"""Packets from captured frames: fixed fields as native expressions, names and handshakes in Arrow batches."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def uint(data: Column, at: Column | int, n: int) -> Column:
    """Big-endian unsigned integer of n bytes (up to 7) at an offset; null if the data ends before."""
    at = F.lit(at) if isinstance(at, int) else at
    return F.when(F.length(data) >= at + n, F.conv(F.hex(F.substring(data, at + 1, F.lit(n))), 16, 10).cast("long"))


def ipv4(data: Column, at: Column | int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.concat_ws(".", *(uint(data, at + i, 1).cast("string") for i in range(4)))


def decode(frames: DataFrame) -> DataFrame:
    """IPv4 packets: addresses, ports and TCP flags (0 where there are none), length, and the transport's payload.

    Frames are Ethernet with IPv4 inside, or bare IPv4 of 20 bytes or more; all others are left out.
    """
    f = F.col("frame")
    ether = (uint(f, 12, 2) == 0x0800) & (F.col("link") == 1)
    bare = (F.shiftright(uint(f, 0, 1), 4) == 4) & (F.length(f) >= 20)
    rows = frames.withColumn("__ip", F.when(ether, 14).when(bare, 0)).where("__ip IS NOT NULL AND length(frame) >= __ip + 20")
    ip = F.col("__ip")
    rows = rows.withColumns({"protocol": uint(f, ip + 9, 1).cast("int"), "__t": ip + uint(f, ip, 1).bitwiseAND(15) * 4})
    t, tcp, udp = F.col("__t"), F.col("protocol") == 6, F.col("protocol") == 17
    port = lambda o: F.coalesce(F.when(tcp | udp, uint(f, t + o, 2)), F.lit(0)).cast("int")
    body = F.when(tcp, t + F.shiftright(uint(f, t + 12, 1), 4) * 4).when(udp, t + 8)
    return rows.withColumns({
        "src_ip": ipv4(f, ip + 12), "dst_ip": ipv4(f, ip + 16), "src_port": port(0), "dst_port": port(2), "length": F.length(f),
        "tcp_flags": F.coalesce(F.when(tcp, uint(f, t + 13, 1)), F.lit(0)).cast("int"), "payload": F.substring(f, (body + 1).cast("int"), F.length(f)),
    }).drop("__ip", "__t", "frame")


def _question(data: bytes) -> tuple[str | None, str | None]:
    """First question of a DNS message, following pointers backwards only."""
    if data is None or len(data) < 17 or not int.from_bytes(data[4:6], "big"):
        return None, None
    labels, at, end, limit = [], 12, 0, len(data)
    while at < len(data) and data[at]:
        n = data[at]
        if n >= 0xC0:
            end, to = end or at + 2, int.from_bytes(data[at : at + 2], "big") & 0x3FFF
            if to >= limit:
                return None, None
            at = limit = to
        else:
            labels.append(data[at + 1 : at + 1 + n].decode("latin-1"))
            at += 1 + n
    end = end or at + 1
    return (".".join(labels), str(int.from_bytes(data[end : end + 2], "big"))) if len(data) >= end + 2 else (None, None)


def dns_question(payload: Column | str) -> Column:
    @F.pandas_udf("qname string, qtype string")
    def parse(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_question(d) for d in data], columns=["qname", "qtype"])

    return parse(payload)


HELLO = "version int, cipher_suites array<int>, extensions array<int>, elliptic_curves array<int>, ec_point_formats array<int>, sni string"


def _hello(raw: bytes | None) -> tuple | None:
    if raw is None or len(raw) < 10:
        return None
    at = 5 if raw[0] == 0x16 else 0
    if raw[at] != 1:
        return None
    u16 = lambda i: struct.unpack_from("!H", raw, i)[0]
    try:
        version, at = u16(at + 4), at + 38
        at += 1 + raw[at]
        n = u16(at)
        ciphers, at = [u16(at + 2 + i) for i in range(0, n - 1, 2)], at + 2 + n
        at += 1 + raw[at]
        extensions, curves, formats, sni = [], [], [], None
        end = at + 2 + u16(at) if at + 2 <= len(raw) else 0
        at += 2
        while at + 4 <= min(end, len(raw)):
            kind, size, body = u16(at), u16(at + 2), at + 4
            extensions.append(kind)
            if kind == 0 and size >= 5:
                sni = raw[body + 5 : body + 5 + u16(body + 3)].decode("utf-8", "replace")
            elif kind == 10 and size >= 2:
                curves = [u16(body + 2 + i) for i in range(0, u16(body) - 1, 2)]
            elif kind == 11 and size >= 1:
                formats = list(raw[body + 1 : body + 1 + raw[body]])
            at = body + size
    except (IndexError, struct.error):  # the message ends within a field
        return None
    return version, ciphers, extensions, curves, formats, sni


def client_hello(raw: Column | str) -> Column:
    """A handshake's first message, from a record or bare; all fields null for anything else or what is cut short."""
    names = [c.split()[0] for c in HELLO.split(", ")]

    @F.pandas_udf(HELLO)
    def parse(data: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([h if (h := _hello(d)) else (None,) * 6 for d in data], columns=names).astype({"version": "Int32"})

    return parse(raw)


def with_names(packets: DataFrame) -> DataFrame:
    """Adds qname and qtype of questions to or from port 53, and tls_raw of TCP payloads that start a handshake record.

    Only rows of port 53 have anything to parse; the payload of all others reaches the function as null.
    """
    dns = F.when((F.col("protocol") == 17) & ((F.col("src_port") == 53) | (F.col("dst_port") == 53)), F.col("payload"))
    tls = F.when((F.col("protocol") == 6) & (F.hex(F.substring("payload", 1, 2)) == "1603"), F.col("payload"))
    rows = packets.withColumn("__q", dns_question(dns))
    return rows.withColumns({"dns_qname": F.rtrim(F.col("__q.qname"), F.lit(".")), "dns_qtype": F.col("__q.qtype"), "tls_raw": tls}).drop("__q", "payload")
