"""Connections as a state machine over ordered packets: establishing, closing, reassembly and parsing.

Used where the outcome depends on the order of all packets: sessions of parsers, TCP closes, reassembled packet lists.
Packets are partitioned by connection key and sorted by Spark, so a task streams through them and holds the state of one
connection at a time; without expiry it keeps only what the reassembly buffer and the parsers hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from packetloom.functions.headers import payload
from packetloom.operators.conntrack import KEY, Timeouts, with_key
from packetloom.operators.reassembly import ACK, FIN, RST, SYN, Content, Stream, TooFarOutOfOrder
from packetloom.parsers.base import Prober
from packetloom.parsers.schema import SESSION
from packetloom.sources.tables import micros

#: Columns of a traced connection.
_FLOW = "struct<nb_pkts: bigint, nb_malformed_pkts: bigint, nb_late_start_pkts: bigint, nb_pkt_bytes: bigint, nb_payload_bytes: bigint, max_simult_gaps: int, data_start: bigint, chunks: array<struct<s: bigint, e: bigint>>, gaps: map<bigint, bigint>, content_gaps: int, missed_bytes: bigint, mean_pkts_to_fill: double, median_pkts_to_fill: bigint>"
SCHEMA = f"conn_id string, ip_version int, proto int, orig_ip binary, orig_port int, resp_ip binary, resp_port int, first_us bigint, second_us bigint, last_us bigint, max_idle_us bigint, history string, service string, closed_by string, pkt_count bigint, byte_count bigint, interarrivals_ctos array<bigint>, interarrivals_stoc array<bigint>, orig_flow {_FLOW}, resp_flow {_FLOW}, packets_orig_reassembled array<bigint>, packets_resp_reassembled array<bigint>, packet_ids array<struct<pkt_id: bigint, dir: boolean>>, parse_errors int, lost_bytes bigint, sessions array<struct<{', '.join(x for x in [SESSION])}>>"


@dataclass
class Packet:
    pkt_id: int
    us: int
    from_hi: bool
    src_ip: bytes
    src_port: int
    dst_ip: bytes
    dst_port: int
    proto: int
    flags: int
    seq: int
    ack: int
    length: int
    frame_len: int
    data: bytes | None


@dataclass
class Flow:
    """Counters of one direction."""

    n: int = 0
    bad: int = 0
    late_start: int = 0
    size: int = 0
    payload: int = 0
    start: int | None = None
    content: Content = field(default_factory=Content)
    last_us: int | None = None
    gaps: list[int] = field(default_factory=list)

    def add(self, p: Packet, keep_gaps: bool) -> None:
        self.n += 1
        self.size += p.frame_len
        if keep_gaps and self.last_us is not None:
            self.gaps.append((p.us - self.last_us) * 1000)
        self.last_us = p.us
        if p.length < 0 or p.data is None and p.length > 0:
            self.bad += 1
            return
        self.payload += p.length
        if p.proto == 6:
            at = (p.seq + (1 if p.flags & SYN else 0)) % (1 << 32)
            if self.start is None:
                self.start = at
            off = (at - self.start) % (1 << 32)
            if off >= 1 << 31:
                self.late_start += 1
            else:
                self.content.insert(off, off + p.length)

    def row(self) -> dict:
        c = self.content
        return {"nb_pkts": self.n, "nb_malformed_pkts": self.bad, "nb_late_start_pkts": self.late_start, "nb_pkt_bytes": self.size, "nb_payload_bytes": self.payload, "max_simult_gaps": c.most_gaps, "data_start": self.start, "chunks": [{"s": s, "e": e} for s, e in c.chunks], "gaps": sorted(c.gaps.items()), "content_gaps": c.content_gaps, "missed_bytes": c.missed_bytes, "mean_pkts_to_fill": c.mean_pkts_to_fill, "median_pkts_to_fill": c.median_pkts_to_fill}


class Connection:
    """State from the first packet on."""

    def __init__(self, p: Packet, protocols: set[str], most_out_of_order: int, lists: bool):
        self.first, self.lists = p, lists
        self.us = [p.us, None, p.us]
        self.idle = 0
        self.orig_hi = p.from_hi
        self.flows = {True: Flow(), False: Flow()}
        self.streams = {True: Stream(most_out_of_order), False: Stream(most_out_of_order)}
        self.history: list[str] = []
        self.prober = Prober(protocols, (p.src_port, p.dst_port), p.proto == 17)
        self.sessions: list[tuple[str, dict]] = []
        self.order: dict[bool, list[int]] = {True: [], False: []}
        self.ids: list[tuple[int, bool]] = []
        self.count = 0
        self.dead = False
        self.errors = 0

    def add(self, p: Packet) -> str | None:
        """Takes a packet; how it closes the connection, if it does."""
        way = p.from_hi == self.orig_hi
        if self.count:
            self.idle = max(self.idle, p.us - self.us[2])
            if self.count == 1:
                self.us[1] = p.us
        self.count += 1
        self.us[2] = p.us
        self._note(p, way)
        if self.lists:
            self.ids.append((p.pkt_id, way))
        self.flows[way].add(p, self.lists)
        if p.proto == 17:
            self._parse(p.data or b"", way)
            return None
        try:
            for pkt_id, data in self.streams[way].push(p.pkt_id, p.seq, p.ack, p.flags, p.data or b""):
                if self.lists:
                    self.order[way].append(pkt_id)
                if data:
                    self._parse(data, way)
        except TooFarOutOfOrder:
            return "out_of_order"
        if p.flags & RST:
            return "rst"
        a, b = self.streams[True], self.streams[False]
        if a.fin and b.fin and a.last_ack == b.next_seq and b.last_ack == a.next_seq:
            return "fin"
        return None

    def _note(self, p: Packet, way: bool) -> None:
        marks = []
        if p.proto == 6:
            marks += [m for m, f in (("S", SYN), ("H", SYN | ACK)) if p.flags == f]
            marks += ["A"] if p.flags == ACK and p.length == 0 else []
            marks += [m for m, f in (("F", FIN), ("R", RST)) if p.flags & f]
        if p.length > 0:
            marks.append("D")
        for m in marks:
            m = m if way else m.lower()
            if m not in self.history:
                self.history.append(m)

    def _parse(self, data: bytes, way: bool) -> None:
        if self.dead:
            return
        try:
            found = self.prober.feed(data, way)
        except Exception:  # one broken session must not end the job: the connection goes on unparsed
            self.dead, found = True, []
            self.errors += 1
        self.sessions += [(self.prober.parser.protocol, s) for s in found]

    def clear(self, lists: bool, record: bool) -> None:
        """What a callback has seen goes: lists of packets, or chunks, gaps and history of a record. Counters go on."""
        if lists:
            self.ids, self.order = [], {True: [], False: []}
        if record:
            self.history = []
            for f in self.flows.values():
                f.content = Content()

    def row(self, closed_by: str, no: int, ended: bool = True) -> dict:
        """The connection as a row; one that goes on keeps its unfinished sessions."""
        p = self.first
        if ended and not self.dead:
            self.sessions += [(self.prober.parser.protocol, s) for s in self.prober.drain()]
        a, b = self.flows[True], self.flows[False]
        structs = ("tls", "http", "dns", "ssh", "quic")
        return {
            "conn_id": f"{p.src_ip.hex()}:{p.src_port}-{p.dst_ip.hex()}:{p.dst_port}-{p.proto}-{self.us[0]}-{p.pkt_id}", "ip_version": 4 if len(p.src_ip) == 4 else 6, "proto": p.proto, "orig_ip": p.src_ip, "orig_port": p.src_port, "resp_ip": p.dst_ip, "resp_port": p.dst_port,
            "first_us": self.us[0], "second_us": self.us[1], "last_us": self.us[2], "max_idle_us": self.idle, "history": "".join(self.history), "service": self.prober.parser.protocol if self.prober.parser else None, "closed_by": closed_by,
            "pkt_count": a.n + b.n, "byte_count": a.size + b.size, "interarrivals_ctos": a.gaps, "interarrivals_stoc": b.gaps, "orig_flow": a.row(), "resp_flow": b.row(), "packets_orig_reassembled": self.order[True], "packets_resp_reassembled": self.order[False], "packet_ids": [{"pkt_id": i, "dir": w} for i, w in self.ids],
            "parse_errors": self.errors, "lost_bytes": sum(x.lost for x in self.prober.all),
            "sessions": [{"session_no": i, "protocol": name, **{k: s if k == name else None for k in structs}} for i, (name, s) in enumerate(self.sessions)],
        }


def trace(packets: Iterable[tuple[object, Packet]], protocols: set[str], timeouts: Timeouts, most_out_of_order: int = 100, lists: bool = True) -> Iterator[dict]:
    """Connections of packets that come ordered by key, time and id. TCP connections begin with a SYN only; packets in the
    middle of none are dropped. UDP ones begin with any packet."""
    key, conn, no = None, None, 0
    for k, p in packets:
        if k != key:
            if conn:
                yield conn.row("end", no)
            key, conn, no = k, None, 0
        if conn and not timeouts.offline:
            window = timeouts.udp if p.proto == 17 else timeouts.establish if conn.count == 1 else timeouts.tcp
            if p.us - conn.us[2] > window:
                yield conn.row("idle", no)
                conn, no = None, no + 1
        if conn is None:
            if p.proto == 6 and p.flags & (SYN | ACK | RST) != SYN:
                continue
            conn = Connection(p, protocols, most_out_of_order, lists)
        closed = conn.add(p)
        if closed:
            yield conn.row(closed, no)
            conn, no = None, no + 1
    if conn:
        yield conn.row("end", no)


def packet_rows(packets: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The key and what a Packet is made of, in its order; packets without addresses, ports or time are left out."""
    have = set(packets.columns)
    data = payload() if {"frame", "payload_off"} <= have else F.col("payload") if "payload" in have else F.lit(None).cast("binary")
    cols = [micros("ts").alias("us"), "from_hi", "src_ip", "src_port", "dst_ip", "dst_port", F.coalesce("tcp_flags", F.lit(0)).alias("flags"), F.coalesce("seq_no", F.lit(0)).cast("bigint").alias("seq"), F.coalesce("ack_no", F.lit(0)).cast("bigint").alias("ack"), F.coalesce("payload_len", F.lit(0)).alias("len"), "frame_len", data.alias("data")]
    return with_key(packets).select(*KEY, "pkt_id", *cols, *(keep or [])).where(F.col("us").isNotNull())


def trace_connections(packets: DataFrame, protocols: set[str] = frozenset(("tls", "http", "dns", "ssh", "quic")), timeouts: Timeouts = Timeouts(), most_out_of_order: int = 100, lists: bool = True, columns: list[str] | None = None) -> DataFrame:
    """One row for each connection, in SCHEMA. packets: decoded frames with pkt_id and ts, frame for the payload.

    columns: those of SCHEMA that are wanted, as rows leave Python whole: lists, flows and sessions that nobody reads cost
    more than the tracing. lists: whether gaps and reassembled packet ids are kept, which makes rows grow with connections. An empty table gives
    no rows; packets without addresses or ports are dropped, and a null frame is a packet without readable payload.
    """
    rows = packet_rows(packets).repartition(*KEY).sortWithinPartitions(*KEY, "us", "pkt_id")
    wanted = frozenset(protocols)
    full = packets.sparkSession.createDataFrame([], SCHEMA)
    kept = full.select(*columns).schema if columns else full.schema
    schema = to_arrow_schema(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import packetloom.parsers  # noqa: F401 registers the parsers on the executor

        def read() -> Iterator[tuple[object, Packet]]:
            for b in batches:
                for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield r[:3], Packet(r[3], r[4], r[5], r[6], r[7], r[8], r[9], r[2], r[10], r[11], r[12], r[13], r[14], r[15])

        out = []
        for row in trace(read(), set(wanted), timeouts, most_out_of_order, lists):
            out.append(row)
            if len(out) >= 256:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, kept)


def sessions_of(connections: DataFrame) -> DataFrame:
    """conn_id, session_id and the columns of each session of traced connections."""
    return connections.select("conn_id", F.explode("sessions").alias("s")).select("conn_id", F.col("s.session_no").alias("session_id"), "s.protocol", "s.tls", "s.http", "s.dns", "s.ssh", "s.quic")


def fold(assigned: DataFrame, columns: list[str], make: Callable[[], object], schema: str) -> DataFrame:
    """A user's own aggregate over the packets of each connection in order: key_hi, key_lo, proto, conn_no and schema.

    make() gives an object with update(**columns), called for every packet, and result(), a dict in schema. Packets are
    those of conntrack.assign(); a task holds one object at a time.
    """
    keys = [*KEY, "conn_no"]
    rows = assigned.select(*keys, micros("ts").alias("__us"), F.col("pkt_id").alias("__id"), *[F.col(c).alias(f"__c{i}") for i, c in enumerate(columns)])
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "__us", "__id").drop("__us", "__id")
    full = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in assigned.select(*keys).schema.fields) + ", " + schema
    arrow = to_arrow_schema(assigned.sparkSession.createDataFrame([], full).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:4] != key:
                    if state is not None:
                        out.append(dict(zip(keys, key, strict=True)) | state.result())
                    key, state = r[:4], make()
                state.update(**dict(zip(columns, r[4:], strict=True)))
            if len(out) >= 1024:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out = []
        if state is not None:
            out.append(dict(zip(keys, key, strict=True)) | state.result())
        if out:
            yield pa.RecordBatch.from_pylist(out, arrow)

    return rows.mapInArrow(run, full)
