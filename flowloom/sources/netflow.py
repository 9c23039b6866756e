"""Records of NetFlow v9 and IPFIX datagrams (columns: seq, data).

A small helper walks each datagram's sets; what templates and data then have to do with each other is an as-of
join by (source, template), and records and fields are cut natively.
"""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.sources.frames import ipv4

#: Names and kinds of fields by number.
FIELDS = {
    1: ("in_bytes", "uint"), 2: ("in_pkts", "uint"), 4: ("protocol", "uint"), 5: ("tos", "uint"), 6: ("tcp_flags", "uint"),
    7: ("src_port", "uint"), 11: ("dst_port", "uint"), 8: ("src_addr", "ipv4"), 12: ("dst_addr", "ipv4"), 15: ("next_hop", "ipv4"),
    10: ("input_snmp", "uint"), 14: ("output_snmp", "uint"), 21: ("last_switched", "uint"), 22: ("first_switched", "uint"),
    27: ("src_addr_v6", "ipv6"), 28: ("dst_addr_v6", "ipv6"), 62: ("next_hop_v6", "ipv6"), 23: ("out_bytes", "uint"), 24: ("out_pkts", "uint"),
    58: ("src_vlan", "uint"), 59: ("dst_vlan", "uint"), 32: ("icmp_type", "uint"), 61: ("direction", "uint"), 56: ("src_mac", "mac"),
    57: ("dst_mac", "mac"), 16: ("src_as", "uint"), 17: ("dst_as", "uint"), 48: ("flow_sampler_id", "uint"),
}

_SETS = "array<struct<source_id:long,export_time:long,template_id:int,record_length:int,fields:array<struct<type:int,at:int,size:int>>,body:binary>>"


def _templates(body: bytes):
    at = 0
    while at + 4 <= len(body):
        number, n = struct.unpack_from("!HH", body, at)
        n = min(n, (len(body) - at - 4) // 4)
        pairs = struct.unpack_from(f"!{2 * n}H", body, at + 4)
        at += 4 + 4 * n
        fields, size = {}, 0
        for kind, length in zip(pairs[::2], pairs[1::2]):
            fields[kind] = {"type": kind, "at": size, "size": length}
            size += length
        if number >= 256:
            yield number, size, list(fields.values())


def _walk(data: bytes | None) -> list[dict]:
    if data is None or len(data) < 16:
        return []
    version = int.from_bytes(data[:2], "big")
    if version == 9 and len(data) >= 20:
        (seconds,), (source,), at, end, announces = struct.unpack_from("!I", data, 8), struct.unpack_from("!I", data, 16), 20, len(data), 0
    elif version == 10:
        length, seconds, _, source = struct.unpack_from("!HIII", data, 2)
        at, end, announces = 16, min(len(data), length), 2
    else:
        return []
    out = []
    while at + 4 <= end:
        number, size = struct.unpack_from("!HH", data, at)
        if size < 4:
            break
        body, base = data[at + 4 : min(at + size, end)], {"source_id": source, "export_time": seconds}
        if number == announces:
            out += [base | {"template_id": t, "record_length": n, "fields": f, "body": None} for t, n, f in _templates(body)]
        elif number >= 256:
            out.append(base | {"template_id": number, "record_length": None, "fields": None, "body": body})
        at += size + (-size % 4 if version == 9 else 0)
    return out


def walked(data: str) -> Column:
    @F.pandas_udf(_SETS)
    def parse(datagrams: pd.Series) -> pd.Series:
        return datagrams.map(_walk)

    return parse(data)


def _ipv6(raw: Column) -> Column:
    """Groups without leading zeros; the longest run of two or more zero groups (the first of equals) becomes '::'."""
    text = F.concat_ws(":", *(F.lower(F.conv(F.hex(F.substring(raw, i, 2)), 16, 16)) for i in range(1, 17, 2)))
    out = text
    for n in range(2, 9):
        run = rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$"
        out = F.when(text.rlike(rf"(^|:)0(:0){{{n - 1}}}(:|$)"), F.regexp_replace(text, run, "$1::$2")).otherwise(out)
    return out


def value(raw: Column, kind: Column) -> Column:
    """A field's bytes as text: by kind, or hexadecimal for other kinds and for addresses of unfit length."""
    h, n = F.lower(F.hex(raw)), F.length(raw)
    number = F.when(n <= 8, F.conv(h, 16, 10)).otherwise(h)
    return (
        F.when(kind == "uint", number).when((kind == "ipv4") & (n == 4), ipv4(raw, 0)).when((kind == "ipv6") & (n == 16), _ipv6(raw))
        .when((kind == "mac") & (n == 6), F.concat_ws(":", *(F.substring(h, i, 2) for i in range(1, 13, 2)))).otherwise(h)
    )


def sets(datagrams: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Data sets with the template of their source announced last before them; data without one is left out.

    One exporter may send most datagrams, so its history is cut into blocks of arrival numbers: within a block the
    last template is carried along, and each block starts with what the blocks before it left.
    """
    rows = datagrams.select("seq", F.posexplode(walked("data")).alias("pos", "s")).select("seq", "pos", "s.*").withColumn("__b", F.floor(F.col("seq") / block))
    rows = rows.withColumn("__t", F.when(F.col("fields").isNotNull(), F.struct("record_length", "fields")))
    key = ["source_id", "template_id"]
    left = rows.where("__t IS NOT NULL").groupBy(*key, "__b").agg(F.max_by("__t", F.struct("seq", "pos")).alias("__end"))
    here = rows.select(*key, "__b").distinct().join(left, [*key, "__b"], "left")
    before = Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    here = here.select(*key, "__b", F.last("__end", ignorenulls=True).over(before).alias("__start"))
    within = Window.partitionBy(*key, "__b").orderBy("seq", "pos")
    own = rows.withColumn("__own", F.last("__t", ignorenulls=True).over(within)).where("body IS NOT NULL")
    out = own.join(here, [*key, "__b"]).withColumn("template", F.coalesce("__own", "__start")).where("template.record_length > 0")
    return out.select("seq", "pos", *key, "export_time", "body", "template")


def records(datagrams: DataFrame) -> DataFrame:
    """One row per record, with `values`: field name to text. Unknown fields are called field_<number>."""
    return cut(sets(datagrams))


def cut(found: DataFrame) -> DataFrame:
    """The records of data sets that have their template."""
    names = F.create_map(*(F.lit(x) for n, (name, kind) in FIELDS.items() for x in (n, F.struct(F.lit(name).alias("name"), F.lit(kind).alias("kind")))))
    size = F.col("template.record_length")
    rows = found.where(F.length("body") >= size)
    rows = rows.withColumn("record", F.explode(F.sequence(F.lit(0), (F.length("body") / size).cast("int") - 1)))

    def entry(f: Column) -> Column:
        known = F.try_element_at(names, f["type"])
        raw = F.substring(F.col("body"), F.col("record") * size + f["at"] + 1, f["size"])
        return F.struct(F.coalesce(known["name"], F.concat(F.lit("field_"), f["type"].cast("string"))), value(raw, F.coalesce(known["kind"], F.lit("raw"))))

    return rows.select("seq", "pos", "record", "source_id", "template_id", "export_time", F.map_from_entries(F.transform("template.fields", entry)).alias("values"))


def wide(decoded: DataFrame) -> DataFrame:
    """Known fields as columns (numbers as decimals, for eight unsigned bytes), the rest in the map `other`."""
    known = [F.try_element_at("values", F.lit(n)).cast("decimal(20,0)" if k == "uint" else "string").alias(n) for n, k in FIELDS.values()]
    other = F.map_filter("values", lambda k, v: k.startswith("field_"))
    return decoded.select(*(c for c in decoded.columns if c != "values"), *known, other.alias("other"))
