"""Packet captures as a Spark source: spark.read.format("pcap").load(path or glob), on any file system that pyarrow knows.

A classic file is cut into ranges of `split` bytes (an option). A range begins at the first of CHAIN plausible record headers in a row, and ends with the
record that starts last before its end. A task reads ranges of up to `pack` bytes (an option; `split` if not given), of one large file or of several whole
ones. Next-generation files, whose blocks depend on those before, are read by one task each, in batches. Both byte orders, micro- and nanoseconds, interfaces' clocks and simple packet blocks are read. A truncated last packet is left out.
"""

from __future__ import annotations

import fnmatch
import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, split int, number long, ts double, link int, wire_length int, frame binary"
#: First four bytes of classic files, as (byte order, ticks a second), and of a section of blocks.
_CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e6), b"\xa1\xb2\xc3\xd4": (">", 1e6), b"\x4d\x3c\xb2\xa1": ("<", 1e9), b"\xa1\xb2\x3c\x4d": (">", 1e9)}
_SECTION = b"\x0a\x0d\x0d\x0a"
#: Rows of a batch; bytes read at once; what a file counts in a pack at least, since opening it takes time too; and the least that a pack holds by default.
_BATCH, _BUFFER, _OPENING, _LEAST = 2000, 1 << 16, 1 << 16, 1 << 20


#: Bytes of a range, the most a captured packet holds, record headers that must follow each other where a range begins, and days that their times may be apart.
SPLIT, LONGEST, CHAIN, DAYS = 128 << 20, 1 << 18, 6, 366
_HEAD = 24


def _plausible(order: str, ticks: float, head: bytes, near: int) -> int:
    """The bytes of the record that starts with this header, or 0 if it can't be one. near: the seconds of the file's first packet."""
    seconds, part, kept, wire = struct.unpack(order + "IIII", head)
    return 16 + kept if part < ticks and 0 < kept <= LONGEST and kept <= wire <= 4 * LONGEST and abs(seconds - near) <= DAYS * 86_400 else 0


def _aligned(f, order: str, ticks: float, near: int, start: int, size: int) -> int:
    """The offset of the first record at or after start (the file's size if there is none)."""
    f.seek(start)
    data = f.read(min(size - start, (CHAIN + 2) * (LONGEST + 16)))
    for at in range(len(data) - 15):
        here, left = at, CHAIN
        while left and here + 16 <= len(data):
            step = _plausible(order, ticks, data[here : here + 16], near)
            if not step:
                break
            here, left = here + step, left - 1
        rest = size - start - here  # a chain may also end with the file: at its end, within a header, or, after some records, within a frame
        if not left or (here > at and 0 <= rest < 16) or (rest < 0 and CHAIN - left > 2):
            return start + at
    return size


def _classic(f, head: bytes, start: int, end: int, size: int) -> Iterator[tuple]:
    order, ticks = _CLASSIC[head]
    f.seek(20)
    link = struct.unpack(order + "I", f.read(4))[0] & 0xFFFF
    first = f.read(16)
    if len(first) < 16:
        return
    at = _HEAD if start == 0 else _aligned(f, order, ticks, struct.unpack(order + "I", first[:4])[0], start, size)
    f.seek(at)
    header = struct.Struct(order + "IIII")
    while at < end and len(h := f.read(16)) == 16:
        seconds, part, kept, wire = header.unpack(h)
        frame = f.read(kept)
        if len(frame) < kept:
            return
        yield seconds + part / ticks, link, wire, frame
        at += 16 + kept


def _blocks(f) -> Iterator[tuple]:
    order, links = "<", []
    f.seek(0)
    while len(h := f.read(8)) == 8:
        if h[:4] == _SECTION:
            mark = f.read(4)
            order, links = "<" if mark == b"\x4d\x3c\x2b\x1a" else ">", []
            f.read(struct.unpack(order + "I", h[4:])[0] - 12)
            continue
        kind, length = struct.unpack(order + "II", h)
        body = f.read(length - 8)
        if len(body) < length - 8 or length < 12:
            return
        if kind == 1:  # an interface: its link type and, among its options, the resolution of its clock
            link, at, ticks = struct.unpack(order + "H", body[:2])[0], 8, 1e6
            while at + 4 <= len(body) - 4:
                code, size = struct.unpack(order + "HH", body[at : at + 4])
                if code == 9 and size == 1:
                    r = body[at + 4]
                    ticks = 2.0 ** (r & 127) if r & 128 else 10.0**r
                if code == 0:
                    break
                at += 4 + (size + 3) // 4 * 4
            links.append((link, ticks, struct.unpack(order + "I", body[4:8])[0]))
        elif kind == 6:
            which, high, low, kept, wire = struct.unpack(order + "IIIII", body[:20])
            link, ticks, _ = links[which]
            yield (high << 32 | low) / ticks, link, wire, body[20 : 20 + kept]
        elif kind == 3 and links:  # a simple packet: no time, of the first interface
            wire = struct.unpack(order + "I", body[:4])[0]
            yield None, links[0][0], wire, body[4 : 4 + min(wire, links[0][2] or wire, len(body) - 8)]


@dataclass
class Range:
    """Bytes start to end of a file."""

    path: str
    split: int
    start: int
    end: int
    size: int


@dataclass
class Pack(InputPartition):
    """The ranges that a task reads: whole files, or neighbouring ranges of one file that is larger than a pack."""

    ranges: list[Range]


def _where(path: str) -> tuple[fs.FileSystem, str]:
    try:
        return fs.FileSystem.from_uri(path)
    except pa.ArrowInvalid:  # a path without a scheme
        return fs.LocalFileSystem(), path


def _found(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The files of a path, folder (names with 'cap') or glob (in its last part)."""
    where, inner = _where(path)
    info = where.get_file_info(inner)
    if info.type == fs.FileType.File:
        return where, [info]
    folder, _, pattern = (inner, "", "*cap*") if info.type == fs.FileType.Directory else inner.rpartition("/")
    inside = where.get_file_info(fs.FileSelector(folder or "/", allow_not_found=True))
    return where, sorted((i for i in inside if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, pattern)), key=lambda i: i.path)


_TYPES = pa.schema([("file", pa.string()), ("split", pa.int32()), ("number", pa.int64()), ("ts", pa.float64()), ("link", pa.int32()), ("wire_length", pa.int32()), ("frame", pa.binary())])


class PcapReader(DataSourceReader):
    """Packets with the number of their pack's first range of the file, counted from there; with the option `counts` one row for each pack of a file larger than a pack, whose number is how many packets it has."""

    def __init__(self, options: dict[str, str]):
        self.path, self.split, self.counts = options["path"], int(options.get("split", SPLIT)), options.get("counts") == "true"
        self.pack = max(int(options.get("pack", self.split)), self.split)

    def partitions(self) -> list[InputPartition]:
        where, files = _found(self.path)
        if not files:
            raise FileNotFoundError(self.path)
        out, room = [], 0
        for i in files:
            if self.counts and i.size <= self.pack:
                continue
            step = max(i.size, 1)
            if i.size > self.split:
                with where.open_input_stream(i.path) as f:
                    step = self.split if f.read(4) in _CLASSIC else step
            ranges = [Range(i.path, k, at, min(at + step, i.size), i.size) for k, at in enumerate(range(0, max(i.size, 1), step))]
            if i.size > self.pack:
                each = self.pack // self.split
                out += [Pack(ranges[k : k + each]) for k in range(0, len(ranges), each)]
                room = 0
            elif out and i.size <= room:
                out[-1].ranges.extend(ranges)
                room -= max(i.size, _OPENING)
            else:
                out.append(Pack(ranges))
                room = self.pack - max(i.size, _OPENING)
        return out

    def _packets(self, pack: Pack) -> Iterator[tuple]:
        where, _ = _where(self.path)
        for path, ranges in groupby(pack.ranges, key=lambda r: r.path):
            first, number = None, 0
            with where.open_input_file(path) as raw:
                f = io.BufferedReader(raw, _BUFFER)
                head = f.read(4)
                for r in ranges:
                    first = r.split if first is None else first
                    for p in _classic(f, head, r.start, r.end, r.size) if head in _CLASSIC else _blocks(f) if head == _SECTION else iter(()):
                        yield path, first, number, *p
                        number += 1

    def read(self, partition: Pack) -> Iterator[pa.RecordBatch]:
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), _TYPES)], schema=_TYPES)
        packets = self._packets(partition)
        if self.counts:
            r = partition.ranges[0]
            yield batch([(r.path, r.split, sum(1 for _ in packets), None, None, None, None)])
            return
        while rows := list(islice(packets, _BATCH)):
            yield batch(rows)


class PcapSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return PcapReader(self.options)


def read(spark: SparkSession, path: str, limit: int = 0, split: int = SPLIT, pack: int | None = None) -> DataFrame:
    """Frames of a file, a folder or a glob, numbered by file; of at most `limit` packets, if given.

    A task reads whole files and numbers them. Only files larger than a pack, what a task reads, are counted first, so that numbers of a pack of ranges go on from those before it.
    """
    spark.dataSource.register(PcapSource)
    sizes = [i.size for i in _found(path)[1]]
    if pack is None:  # some four a core, neither tiny nor larger than SPLIT
        pack = min(SPLIT, max(_LEAST, sum(sizes) // (4 * spark.sparkContext.defaultParallelism)))
    pack = max(pack, split)
    source = spark.read.format("pcap").option("split", split).option("pack", pack)
    frames = source.load(path)
    if any(size > pack for size in sizes):
        ahead = F.sum("number").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))  # a row a pack
        several = source.option("counts", "true").load(path).select("file", "split", ahead.alias("__ahead"))
        frames = frames.join(F.broadcast(several), ["file", "split"], "left").withColumn("number", F.col("number") + F.coalesce("__ahead", F.lit(0))).drop("__ahead")
    frames = frames.drop("split")
    return frames.orderBy("file", "number").limit(limit) if limit else frames


def write(frames: DataFrame, path: str) -> None:
    """Frames (ts, link, frame; in order of number) as a classic capture of microseconds, a file for each `file`: what `read` reads. Each file is written by one task."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.sort_by("number")
        where, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        where.create_dir(inner)
        with where.open_output_stream(f"{inner}/{key[0].as_py()}") as f:
            parts, header = [struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, LONGEST, rows["link"][0].as_py())], struct.Struct("<IIII")
            for ts, frame in zip(rows["ts"].to_pylist(), rows["frame"].to_pylist(), strict=True):
                micros = round(ts * 1e6)
                parts += header.pack(micros // 1_000_000, micros % 1_000_000, len(frame), len(frame)), frame
            f.write(b"".join(parts))
        return pa.table({"n": [len(rows)]})

    frames.select("file", "number", "ts", "link", "frame").groupBy("file").applyInArrow(run, "n long").agg(F.sum("n")).collect()


def with_seq(frames: DataFrame, rank: Column | None = None) -> DataFrame:
    """Adds `seq`, ascending by (file, number); files must sort by time, as rotated captures do. rank: the file's number, if its name tells it; without, all files are looked at first."""
    seq = lambda rank: (rank * F.lit(1 << 40) + F.col("number")).cast("long")
    if rank is not None:
        return frames.withColumn("seq", seq(rank))
    files = frames.select("file").distinct().withColumn("__f", F.dense_rank().over(Window.orderBy("file")) - 1)  # one row a file
    return frames.join(files, "file").withColumn("seq", seq(F.col("__f"))).drop("__f")
