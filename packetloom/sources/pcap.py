"""Packet captures as a Spark source and sink: format("pcap"), classic and next-generation files, batch and streaming.

Files are read through Arrow's file systems, so a path may be local or a URI (s3://, gs://, hdfs://, file://). A classic
file larger than split_bytes is read in ranges, each by a task of its own: a range begins where record headers lead that
follow each other for longer than any frame can be. Bytes of a frame may look like a header that leads to a true one, so
the first of them may be false; the last is the one to which most lead. A task that reads up to the next range looks
where that one begins; if the records it has read end elsewhere, it raises, so a range is never silently misread.
Next-generation files are one task each.

Options: path (a file, a folder or a glob), mtu (frames longer on the wire are skipped; 9702 by default, 0 for none),
split_bytes (0 for none), files_per_batch for streams.
"""

from __future__ import annotations

import fnmatch
import os
import struct
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, InputPartition, WriterCommitMessage

SCHEMA = "pkt_id bigint, ts timestamp, frame_len int, orig_len int, frame binary, file string"
MTU = 9702
SPLIT_BYTES = 256 << 20
_BATCH = 4096
#: Byte order and ticks a second of the fixed values that open a classic file.
_MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
_NG = b"\x0a\x0d\x0d\x0a"
#: No frame is kept longer.
_LONGEST = 262_144


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def _head(f, path: str) -> tuple[str, int]:
    magic = f.read(4)
    if magic not in _MAGIC:
        raise ValueError(f"no capture file: {path}")
    return _MAGIC[magic]


def _leads(data: bytes, at: int, goal: int, order: str, unit: int, to_end: bool, known: dict[int, int | None]) -> int | None:
    """Where record headers lead that follow each other from data[at:] up to the goal or the end of the file; None if they
    don't. known: what has been found so far."""
    path: list[int] = []
    while at not in known:
        if at >= goal:
            there: int | None = at
            break
        if at + 16 > len(data):
            there = len(data) if to_end and (path or at == len(data)) else None
            break
        path.append(at)
        _, part, kept, length = struct.unpack_from(order + "IIII", data, at)
        if kept > min(length, _LONGEST) or part >= 1_000_000 * unit or length == 0:
            there = None
            break
        at += 16 + kept
    else:
        there = known[at]
    known.update(dict.fromkeys(path, there))
    return there


def first_record(f, size: int, start: int, order: str, unit: int) -> int:
    """The place of a record that all readers find, two longest frames after start, or the size of the file: the one to
    which most places lead that may be records."""
    at, near = start, _LONGEST + 16
    while at < size:
        f.seek(at)
        data = f.read(3 * near)
        known: dict[int, int | None] = {}
        led = Counter(_leads(data, i, 2 * near, order, unit, at + len(data) >= size, known) for i in range(min(len(data), near + 1)))
        del led[None]
        if led:
            return min(at + max(led, key=lambda x: led[x]), size)
        at += near + 1
    return size


def read_pcap(path: str, start: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, bytes]]:
    """(place in the file, microseconds, length on the wire, captured bytes) of each frame from first_record() of start to
    that of end; a file cut short ends where it is cut."""
    system, name = _open(path)
    with system.open_input_file(name) as f:
        if f.read(4) == _NG:
            for i, (us, length, data) in enumerate(_read_ng(f)):
                yield i, us, length, data
            return
        f.seek(0)
        order, unit = _head(f, path)
        size = f.size()
        at = 24 if start <= 24 else first_record(f, size, start, order, unit)
        stop = size if end is None or end >= size else first_record(f, size, end, order, unit)
        f.seek(at)
        buffer, base = b"", at
        while at < stop:
            if at - base + 16 > len(buffer):
                buffer, base = buffer[at - base :] + f.read(1 << 20), at
            if len(buffer) - (at - base) < 16:
                return
            sec, part, kept, length = struct.unpack_from(order + "IIII", buffer, at - base)
            while at - base + 16 + kept > len(buffer):
                more = f.read(max(1 << 20, kept))
                if not more:
                    return
                buffer, base = buffer[at - base :] + more, at
            here = at - base + 16
            yield at, sec * 1_000_000 + part // unit, length, buffer[here : here + kept]
            at += 16 + kept
        if stop < size and at != stop:
            raise ValueError(f"{path} can't be split at {end}: records go on at {at}, not {stop}; read it with split_bytes 0")


def _read_ng(f) -> Iterator[tuple[int, int, bytes]]:
    """(microseconds, length on the wire, captured bytes) of each packet block."""
    f.seek(0)
    order, units = "<", []
    while len(head := f.read(8)) == 8:
        kind = struct.unpack("<I", head[:4])[0]
        if kind == 0x0A0D0D0A:
            mark = f.read(4)
            order = "<" if mark == b"\x4d\x3c\x2b\x1a" else ">"
            size = struct.unpack(order + "I", head[4:])[0]
            f.read(size - 12)
            units = []
            continue
        kind, size = struct.unpack(order + "II", head)
        body = f.read(size - 8)
        if len(body) < size - 8:
            return
        body = body[:-4]
        if kind == 1:
            units.append(_unit(body[8:], order))
        elif kind == 6:
            port, high, low, kept, length = struct.unpack(order + "IIIII", body[:20])
            ticks = units[port] if port < len(units) else 1_000_000
            yield (high << 32 | low) * 1_000_000 // ticks, length, body[20 : 20 + kept]
        elif kind == 3:
            length = struct.unpack(order + "I", body[:4])[0]
            yield 0, length, body[4 : 4 + length]


def _unit(options: bytes, order: str) -> int:
    """Ticks a second of an interface."""
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack(order + "HH", options[at : at + 4])
        if code == 9 and size:
            v = options[at + 4]
            return 1 << (v & 127) if v & 128 else 10**v
        if code == 0:
            break
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


def write_pcap(path: str, frames: list[tuple[int, bytes]], snap: int = 65535) -> None:
    """A classic file of (microseconds, frame)."""
    system, name = _open(path)
    with system.open_output_stream(name) as f:
        _write(f, frames, snap)


def _write(f, frames, snap: int = 65535, head: bool = True) -> None:
    if head:
        f.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, snap, 1))
    for us, data in frames:
        f.write(struct.pack("<IIII", us // 1_000_000, us % 1_000_000, min(len(data), snap), len(data)) + data[:snap])


class _Range(InputPartition):
    def __init__(self, number: int, path: str, start: int = 0, end: int | None = None):
        self.number, self.path, self.start, self.end = number, path, start, end


def _files(path: str) -> list[tuple[str, int]]:
    """Path and size of the capture files, in the order of their names."""
    system, name = _open(path)
    prefix = path[: len(path) - len(name)] if "://" in path else ""
    info = system.get_file_info(name) if not any(c in name for c in "*?[") else None
    if info is not None and info.type == fs.FileType.File:
        return [(path, info.size)]
    if info is not None and info.type == fs.FileType.Directory:
        folder, pattern = name, "*.pcap*"
    else:
        folder, pattern = os.path.split(name)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted((prefix + x.path, x.size) for x in found if x.type == fs.FileType.File and fnmatch.fnmatch(x.base_name, pattern))


def _ranges(number: int, path: str, size: int, split: int) -> list[_Range]:
    if split <= 0 or size <= split:
        return [_Range(number, path)]
    system, name = _open(path)
    with system.open_input_file(name) as f:
        if f.read(4) == _NG:
            return [_Range(number, path)]
    cuts = [*range(0, size, split), size]
    return [_Range(number, path, a, b if b < size else None) for a, b in zip(cuts, cuts[1:], strict=False)]


def _batches(part: _Range, mtu: int) -> Iterator[pa.RecordBatch]:
    names = ["pkt_id", "ts", "frame_len", "orig_len", "frame", "file"]
    rows: list[tuple] = []

    def made() -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        types = [pa.int64(), pa.timestamp("us", tz="UTC"), pa.int32(), pa.int32(), pa.binary(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    # ids are unique over files: the file's number in the high bits, the frame's place in it in the low ones
    for at, us, length, data in read_pcap(part.path, part.start, part.end):
        if mtu and length > mtu:
            continue
        rows.append((part.number << 44 | at, us, length, length, data, part.path))
        if len(rows) >= _BATCH:
            yield made()
            rows = []
    if rows:
        yield made()


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.mtu, self.split = options["path"], int(options.get("mtu", MTU)), int(options.get("split_bytes", SPLIT_BYTES))

    def partitions(self):
        return [r for i, (p, size) in enumerate(_files(self.path)) for r in _ranges(i, p, size, self.split)]

    def read(self, partition):
        yield from _batches(partition, self.mtu)


class _StreamReader(DataSourceStreamReader):
    """Offsets count files in the order of their names; a capture process must name them so and move them in whole."""

    def __init__(self, options: dict):
        self.path, self.mtu = options["path"], int(options.get("mtu", MTU))
        self.step = int(options.get("files_per_batch", 16))
        self.at = 0

    def initialOffset(self):
        return {"file": 0}

    def latestOffset(self):
        self.at = min(len(_files(self.path)), self.at + self.step)
        return {"file": self.at}

    def partitions(self, start, end):
        self.at = max(self.at, end["file"])
        return [_Range(i, p) for i, (p, _) in enumerate(_files(self.path)) if start["file"] <= i < end["file"]]

    def read(self, partition):
        yield from _batches(partition, self.mtu)

    def commit(self, end):
        pass


class _Written(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class _Writer(DataSourceArrowWriter):
    """One file a task; rows have ts and frame, in the order in which they come. Files of failed tasks are removed."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.run = options["path"], overwrite, uuid.uuid4().hex[:12]

    def write(self, iterator):
        from pyspark import TaskContext

        task = TaskContext.get()
        out = None
        system, folder = _open(self.path)
        name = f"{folder}/part-{task.partitionId():06d}-{self.run}-{task.taskAttemptId()}.pcap"
        for b in iterator:
            if out is None:
                system.create_dir(folder)
                out = system.open_output_stream(name)
                _write(out, [])
            ts = b.column(b.schema.get_field_index("ts")).cast(pa.timestamp("us", tz="UTC")).cast(pa.int64()).to_pylist()
            _write(out, [(us, f) for us, f in zip(ts, b.column(b.schema.get_field_index("frame")).to_pylist(), strict=True) if us is not None and f is not None], head=False)
        if out is not None:
            out.close()
        return _Written(None if out is None else name)

    def commit(self, messages):
        if self.overwrite:
            kept = {m.path for m in messages if m and m.path}
            system, folder = _open(self.path)
            for x in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if x.type == fs.FileType.File and x.base_name.endswith(".pcap") and x.path not in kept:
                    system.delete_file(x.path)

    def abort(self, messages):
        system, _ = _open(self.path)
        for m in messages:
            if m and m.path:
                system.delete_file(m.path)


class PcapSource(DataSource):
    @classmethod
    def name(cls):
        return "pcap"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _StreamReader(self.options)

    def writer(self, schema, overwrite):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PcapSource)


def read(spark: SparkSession, path: str, mtu: int = MTU, split_bytes: int = SPLIT_BYTES, seen: Observation | None = None) -> DataFrame:
    """Frames of captures, with the id that orders them. seen counts what is skipped as longer than mtu: oversize_pkts and
    oversize_bytes, filled while some action runs over the frames."""
    register(spark)
    load = lambda m: spark.read.format("pcap").option("mtu", m).option("split_bytes", split_bytes).load(path)
    if seen is None:
        return load(mtu)
    over = F.col("orig_len") > mtu
    one = lambda v: F.coalesce(F.sum(F.when(over, v)), F.lit(0)).cast("bigint")
    return load(0).observe(seen, one(F.lit(1)).alias("oversize_pkts"), one(F.col("orig_len")).alias("oversize_bytes")).where(~over)


def write(frames: DataFrame, path: str, mode: str = "append") -> None:
    """Frames (ts, frame) as classic files, one a task."""
    register(frames.sparkSession)
    frames.select("ts", "frame").write.format("pcap").mode(mode).save(path)
