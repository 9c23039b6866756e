"""Captures, frames, handshakes and flow exports built by hand, byte by byte."""

import struct

import pytest
from pyspark.sql import functions as F

from flowloom.sources import frames, netflow, pcap

ETHER = b"\0" * 12 + b"\x08\x00"


def packet(payload=b"", protocol=6, sport=1234, dport=443, flags=2, options=b""):
    ip = struct.pack("!BBHHHBBH4s4s", 0x45 + len(options) // 4, 0, 0, 0, 0, 64, protocol, 0, bytes([10, 0, 0, 1]), bytes([192, 168, 1, 200])) + options
    if protocol == 6:
        return ip + struct.pack("!HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 0, 0, 0) + payload
    return ip + (struct.pack("!HHHH", sport, dport, 8 + len(payload), 0) if protocol == 17 else b"") + payload


def hello():
    body = struct.pack("!H", 771) + b"r" * 32 + b"\0" + struct.pack("!H3H", 6, 47, 53, 10) + b"\x01\0"
    name = b"\0" + struct.pack("!H", 9) + b"some.host"
    ext = struct.pack("!HHH", 0, len(name) + 2, len(name)) + name + struct.pack("!HHHHH", 10, 6, 4, 23, 24) + struct.pack("!HHBB", 11, 2, 1, 0)
    body += struct.pack("!H", len(ext)) + ext
    shake = b"\x01" + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x01" + struct.pack("!H", len(shake)) + shake


DNS = struct.pack("!HHHHHH", 7, 256, 1, 0, 0, 0) + b"\x03www\x07example\x03com\0" + struct.pack("!HH", 16, 1)
FRAMES = [ETHER + packet(hello()), ETHER + packet(DNS, 17, 5353, 53), ETHER + packet(b"", 1), ETHER + packet(b"", 6, options=b"\x01" * 4), b"\0" * 12 + b"\x86\xdd" + b"\0" * 40, packet(b"", 17, 1, 2), b"short"]


@pytest.mark.parametrize("order", ["<", ">"])
def test_classic_capture(spark, tmp_path, order):
    with open(tmp_path / "a.pcap", "wb") as f:
        f.write(struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        for i, x in enumerate(FRAMES):
            f.write(struct.pack(order + "IIII", 1_700_000_000 + i, 500_000, len(x), len(x)) + x)
        f.write(b"\0" * 7)  # cut short
    rows = pcap.with_seq(pcap.read(spark, str(tmp_path)))
    got = frames.with_names(frames.decode(rows)).orderBy("seq").collect()
    assert [r["seq"] for r in got] == [0, 1, 2, 3, 5] and got[0]["ts"] == 1_700_000_000.5
    assert [(r["protocol"], r["src_port"], r["dst_port"], r["tcp_flags"]) for r in got] == [(6, 1234, 443, 2), (17, 5353, 53, 0), (1, 0, 0, 0), (6, 1234, 443, 2), (17, 1, 2, 0)]
    assert {(r["src_ip"], r["dst_ip"]) for r in got} == {("10.0.0.1", "192.168.1.200")}
    assert (got[1]["dns_qname"], got[1]["dns_qtype"]) == ("www.example.com", "16")
    assert bytes(got[0]["tls_raw"]) == hello() and got[1]["tls_raw"] is None
    assert pcap.read(spark, str(tmp_path), limit=2).count() == 2


def test_block_capture(spark, tmp_path):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    x = FRAMES[0] + b"\0" * (-len(FRAMES[0]) % 4)
    with open(tmp_path / "b.pcapng", "wb") as f:
        f.write(block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 0) + struct.pack("<HHB3xHH", 9, 1, 9, 0, 0)))
        f.write(block(6, struct.pack("<IIIII", 0, 0, 2_500_000_000, len(FRAMES[0]), len(FRAMES[0])) + x))
    row = pcap.read(spark, str(tmp_path / "b.pcapng")).first()
    assert row["ts"] == 2.5 and bytes(row["frame"]) == FRAMES[0]


def test_simple_packets_and_globs(spark, tmp_path):
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    (tmp_path / "x1.pcapng").write_bytes(block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 8)) + block(3, struct.pack("<I", 60) + b"12345678"))
    (tmp_path / "other").write_bytes(b"")
    row = pcap.read(spark, f"{tmp_path}/x*.pcapng").first()
    assert (row["ts"], row["wire_length"], bytes(row["frame"])) == (None, 60, b"12345678")
    assert pcap.read(spark, f"file://{tmp_path}/x1.pcapng").count() == 1


@pytest.mark.parametrize("order", ["<", ">"])
def test_ranges_of_a_capture(spark, tmp_path, order):
    """The same packets in the same order, whole or in ranges shorter and longer than a packet; payloads look like headers at times."""
    import random

    rnd, sent = random.Random(8), []
    with open(tmp_path / "a.pcap", "wb") as f:
        f.write(struct.pack(order + "IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        for i in range(400):
            body = rnd.randbytes(rnd.choice([0, 1, 15, 40, 700]))
            if i % 9 == 0:
                body += struct.pack(order + "IIII", 1_700_000_000, 5, 60, 60)
            sent.append(b"%d" % i + body)
            f.write(struct.pack(order + "IIII", 1_700_000_000 + i, i, len(sent[-1]), len(sent[-1])) + sent[-1])
    size = (tmp_path / "a.pcap").stat().st_size
    for split in (1 << 30, size // 16, 5000, 900):
        frames = pcap.read(spark, str(tmp_path / "a.pcap"), split=split)
        got = {r["number"]: (r["ts"], bytes(r["frame"])) for r in frames.collect()}
        assert len(pcap.PcapReader({"path": str(tmp_path / "a.pcap"), "split": str(split)}).partitions()) == -(-size // split)
        assert got == {i: (1_700_000_000 + i + i / 1e6, x) for i, x in enumerate(sent)}, split


def test_many_captures_take_few_tasks(spark, tmp_path):
    """Tasks grow with bytes, not with files; files of one task and of several are numbered alike, empty ones and next-generation ones among them."""
    sent = {}
    for k in range(120):
        n = 3000 if k == 50 else 0 if k == 7 else 20 + k % 5
        sent |= {(f"{k:03d}.pcap", i): b"%d-%d" % (k, i) + b"x" * (i % 40) for i in range(n)}
        with open(tmp_path / f"{k:03d}.pcap", "wb") as f:
            f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
            for i in range(n):
                x = sent[f"{k:03d}.pcap", i]
                f.write(struct.pack("<IIII", 1_700_000_000 + i, i, len(x), len(x)) + x)
    block = lambda kind, body: struct.pack("<II", kind, 12 + len(body)) + body + struct.pack("<I", 12 + len(body))
    (tmp_path / "200.pcapng").write_bytes(block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 8)) + 900 * block(3, struct.pack("<I", 60) + b"12345678"))
    sent |= {("200.pcapng", i): b"12345678" for i in range(900)}
    for split in (500, 4000, 1 << 20):
        frames, cut = pcap.read(spark, str(tmp_path), split=split), pcap.read(spark, str(tmp_path), split=split, pack=9000)
        for got in (frames, cut):
            assert sorted((r["file"].rsplit("/")[-1], r["number"], bytes(r["frame"])) for r in got.collect()) == sorted((*k, x) for k, x in sent.items()), split
        packs = pcap.PcapReader({"path": str(tmp_path), "split": str(split), "pack": str(1 << 20)}).partitions()
        assert len(packs) == 8 and sum(r.end - r.start for p in packs for r in p.ranges) == sum(f.stat().st_size for f in tmp_path.iterdir())
        assert frames.rdd.getNumPartitions() < 60, split


PACKET = "seq long, ts double, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, length int, tcp_flags int"


def test_captures_keep_hosts_and_numbers(spark, monkeypatch):
    """Hosts past 65,535, whose third number is no byte, numbers with gaps of whole files, and times at half a millisecond."""
    from flowloom.plans import packet_queries as plans

    rows = [(5, 1.0625, "10.0.0.1", "198.51.100.2", 40001, 443, 6, 60, 2), (9, 2.0015, "198.51.100.2", "10.0.255.255", 443, 40002, 6, 60, 18), (3 * 4096 + 7, 3.0, "10.0.256.0", "198.51.100.1", 40003, 53, 17, 60, 0), (9 * 4096, 4.25, "10.0.65535.144", "198.51.100.0", 40004, 80, 6, 60, 16)]
    monkeypatch.setattr(plans, "view", lambda spark, sf_dir, name: spark.createDataFrame(rows, PACKET))
    got = plans.s_captures(spark, "").orderBy("seq").collect()
    assert [tuple(r)[2:] for r in got] == [(*r[2:7], r[8]) for r in rows]
    assert [r["seq"] for r in got] == [0, 1, 3 << 40, 9 << 40] and [r["ts"] for r in got] == [1.063, 2.002, 3.0, 4.25]


def test_decoded_frames_keep_hosts(spark, monkeypatch):
    from flowloom.plans import packet_queries as plans

    rows = [(1, 1.0, "10.0.0.1", "198.51.100.2", 40001, 443, 6, 60, 2), (2, 2.0, "198.51.100.2", "10.0.351.144", 53, 40002, 17, 60, 0), (3, 3.0, "10.0.70000.7", "198.51.100.1", 40003, 443, 6, 60, 2)]
    monkeypatch.setattr(plans, "view", lambda spark, sf_dir, name: spark.createDataFrame(rows, PACKET))
    got = plans.s_decode(spark, "").orderBy("seq").collect()
    assert [tuple(r)[:7] for r in got] == [(r[0], *r[2:7], r[8]) for r in rows]
    assert [(r["dns_qname"], r["is_tls"], r["size"]) for r in got] == [(None, True, 40), ("host2.example.com", False, 77), (None, True, 54)]


def test_exports_keep_hosts(spark, monkeypatch):
    """Hosts past 65,535, in either order of a template's addresses."""
    from flowloom.plans import packet_queries as plans

    rows = [(1, "10.1.255.7", "203.0.113.1", 2, 6, 1, 1, 700, 0, 1e9, 0.1), (14, "10.1.256.8", "203.0.113.14", 15, 6, 1, 1, 800, 0, 1e9, 0.1), (15, "10.1.3515.9", "203.0.113.15", 16, 17, 1, 1, 900, 0, 1e9, 0.1), (24, "10.1.65300.5", "203.0.113.24", 25, 6, 1, 1, 100, 0, 1e9, 0.1)]
    made = spark.createDataFrame(rows, "seq long, src_ip string, dst_ip string, dst_port int, protocol int, packets_fwd long, packets_bwd long, bytes_fwd long, bytes_bwd long, start_time double, duration double")
    monkeypatch.setattr(plans, "view", lambda spark, sf_dir, name: made)
    got = plans.s_exports(spark, "").orderBy("seq", "record").collect()
    hosts = {r[0]: {r[1], r[2]} for r in rows}
    assert {r["seq"] for r in got} >= {1, 24} and all({r["src_addr"], r["dst_addr"]} == hosts[r["seq"]] for r in got)


def test_missing_capture(spark, tmp_path):
    with pytest.raises(Exception, match="FileNotFoundError"):
        pcap.read(spark, str(tmp_path / "none.pcap")).count()


def test_handshake(spark):
    raw = [(0, hello()), (1, hello()[5:]), (2, hello()[:60]), (3, b"x"), (4, None)]
    got = spark.createDataFrame(raw, "i int, raw binary").select("i", frames.client_hello("raw").alias("h")).orderBy("i").collect()
    want = (771, [47, 53, 10], [0, 10, 11], [23, 24], [0], "some.host")
    assert tuple(got[0]["h"]) == want and tuple(got[1]["h"]) == want
    assert got[3]["h"]["version"] is None and got[4]["h"]["version"] is None


FIELDS = [(8, 4), (12, 4), (7, 2), (11, 2), (4, 1)]
RECORD = bytes([10, 0, 0, 1, 10, 0, 0, 2]) + struct.pack("!HHB", 1000, 443, 6)


def v9(parts, source=100, seconds=1_700_000_000):
    out = struct.pack("!HHIIII", 9, 1, 0, seconds, 1, source)
    for number, body in parts:
        out += struct.pack("!HH", number, 4 + len(body)) + body + b"\0" * (-len(body) % 4)
    return out


def template(number, fields):
    return struct.pack("!HH", number, len(fields)) + b"".join(struct.pack("!HH", *f) for f in fields)


def test_v9_and_ipfix(spark):
    other = struct.pack("!HH", 256, 4 + 2) + b"ab"
    ipfix_body = struct.pack("!HH", 2, 4 + 12) + template(300, [(27, 16), (999, 3)]) + struct.pack("!HH", 300, 4 + 19) + bytes.fromhex("20010db8000000000000000000000001") + b"\x01\x02\x03"
    ipfix = struct.pack("!HHIII", 10, 16 + len(ipfix_body), 77, 1, 5) + ipfix_body
    rows = [
        (1, v9([(256, RECORD)])),  # no template yet
        (2, v9([(0, template(256, FIELDS)), (1, b"1234"), (256, RECORD * 2)])),
        (3, v9([(256, RECORD)], source=101)),  # another source
        (4, v9([(0, template(256, [(1, 8)])), (256, b"\xff" * 8)])),  # the last definition holds
        (70_000, v9([(256, b"\x00" * 7 + b"\x05")])),  # in a later block
        (70_001, ipfix + other), (70_002, b"\0\5xx"), (70_003, None), (70_004, v9([])[:18]),
    ]
    got = netflow.wide(netflow.records(spark.createDataFrame(rows, "seq long, data binary"))).orderBy("seq", "pos", "record").collect()
    assert [r["seq"] for r in got] == [2, 2, 4, 70_000, 70_001]
    first = got[0]
    assert (first["src_addr"], first["dst_addr"], int(first["src_port"]), int(first["dst_port"]), int(first["protocol"]), first["export_time"]) == ("10.0.0.1", "10.0.0.2", 1000, 443, 6, 1_700_000_000)
    assert int(got[2]["in_bytes"]) == 2**64 - 1 and int(got[3]["in_bytes"]) == 5
    assert got[4]["src_addr_v6"] == "2001:db8::1" and got[4]["other"] == {"field_999": "010203"}


@pytest.mark.parametrize("text", ["::", "::1", "1::", "1:0:2::3", "fe80::1:0:0:1", "1:2:3:4:5:6:7:8", "1:0:2:3:4:5:6:7"])
def test_ipv6_text(spark, text):
    import ipaddress

    raw = F.unhex(F.lit(ipaddress.IPv6Address(text).packed.hex()))
    assert spark.range(1).select(netflow.value(raw, F.lit("ipv6"))).first()[0] == str(ipaddress.IPv6Address(text))
