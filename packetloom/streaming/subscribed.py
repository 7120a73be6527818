"""Subscriptions over streams: callbacks while a connection goes on, for filters of any stage and all data that can be
streamed (firings), and sessions and connections as they are done (deliver_stream).

A connection is traced packet by packet. A filter that packets decide matches at its first packet; one that asks for the
protocol or a session matches when that is known, and triggers count from the next packet on. At each firing the data of
the connection so far are delivered; then lists of packets are emptied, and with records the chunks, gaps and history,
while counters go on. The same state machine runs over tables and over streams, where its state is kept by Spark.
"""

from __future__ import annotations

import base64
import json
import pickle
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetloom.filterlang import Filter
from packetloom.filterlang.interpret import matches, on_connection
from packetloom.operators.conntrack import KEY, Timeouts
from packetloom.operators.reassembly import ACK, RST, SYN
from packetloom.operators.trace import SCHEMA, Connection, Packet, packet_rows
from packetloom.plans.subscribe import DATATYPES, Level, Subscription, SubscriptionError, _project
from packetloom.sources.traffic import connection_columns
from packetloom.streaming.triggers import Trigger, Until

#: Columns of a firing besides those of the traced connection.
FIRED = "pkt_id bigint, us bigint, firing int"
_FULL = f"{FIRED}, {SCHEMA}"
_LISTS = frozenset(n for n in DATATYPES if "Pkt" in n and n != "PktCount")


class Subscribed:
    """A subscription's state for one connection key; packets come in order."""

    def __init__(self, sub: Subscription, timeouts: Timeouts, until: Until | None, most_out_of_order: int = 100):
        self.sub, self.timeouts, self.until, self.most = sub, timeouts, until, most_out_of_order
        self.no = 0
        self._reset()

    def _reset(self) -> None:
        self.conn: Connection | None = None
        self.trigger = Trigger(*self.sub.streaming, Timeouts(offline=True), self.until)
        self.matched, self.seen = False, 0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("sub", "timeouts", "until")}

    def bound(self, sub: Subscription, timeouts: Timeouts, until: Until | None) -> Subscribed:
        self.sub, self.timeouts, self.until = sub, timeouts, until
        self.trigger.until = until
        return self

    def packet(self, p: Packet) -> dict | None:
        """The row of a firing at this packet, if it fires."""
        c = self.conn
        if c and not self.timeouts.offline:
            window = self.timeouts.udp if p.proto == 17 else self.timeouts.establish if c.count == 1 else self.timeouts.tcp
            if p.us - c.us[2] > window:
                self._reset()
                self.no += 1
                c = None
        if c is None:
            if p.proto == 6 and p.flags & (SYN | ACK | RST) != SYN:
                return None
            lists = bool(_LISTS & set(self.sub.datatypes)) or "InterArrivals" in self.sub.datatypes
            c = self.conn = Connection(p, self.sub.protocols, self.most, lists)
            self.matched = self.sub.parsed.stage() == "packet"
        ready = self.matched
        closed = c.add(p)
        out = None
        # counters of the trigger are the connection's; it counts towards the next firing from the match on
        self.trigger.pkts, self.trigger.bytes = c.count - 1, sum(f.size for f in c.flows.values()) - p.frame_len
        if ready and self.trigger.packet(p.us, p.frame_len, p.proto == 17):
            out = c.row("open", self.no, ended=False) | {"pkt_id": p.pkt_id, "us": p.us, "firing": self.trigger.firings}
            c.clear(bool(_LISTS & set(self.sub.datatypes)), "ConnRecord" in self.sub.datatypes)
        if not self.matched:
            self.matched = self._match(c)
        if closed:
            self._reset()
            self.no += 1
        return out

    def _match(self, c: Connection) -> bool:
        f: Filter = self.sub.parsed
        if c.prober.parser is None:
            return False
        ends = _ends(c)
        service = c.prober.parser.protocol
        wanted = next((x for d in self.sub.datatypes if (x := DATATYPES[d].protocol)), None)
        if f.stage() == "protocol" and wanted is None:
            return matches(f.tree, on_connection(ends, service))
        new, self.seen = c.sessions[self.seen :], len(c.sessions)
        return any(matches(f.tree, on_connection(ends, name, s)) for name, s in new if wanted in (None, name))


def _deliverable(sub: Subscription) -> None:
    if not sub.streaming:
        raise SubscriptionError("the subscription has no trigger")
    left = [d for d in sub.datatypes if not (DATATYPES[d].streamable or DATATYPES[d].protocol or d in ("FiveTuple", "FilterStr", "CoreId"))]
    if left:
        raise SubscriptionError(f"can't be delivered while a connection goes on: {left}")


def _delivered(fired: DataFrame, sub: Subscription) -> DataFrame:
    """pkt_id, us, firing, conn_id and the data wanted."""
    rows = connection_columns(fired)
    protocol = next((p for d in sub.datatypes if (p := DATATYPES[d].protocol)), None)
    if protocol:
        rows = rows.withColumn(protocol, F.get(F.filter("sessions", lambda s: s["protocol"] == protocol), F.lit(0))[protocol])
    return _project(rows, sub, ["conn_id", "pkt_id", "us", "firing"])


def firings(sub: Subscription, packets: DataFrame, timeouts: Timeouts = Timeouts(), until: Until | None = None, late: str = "10 minutes") -> DataFrame:
    """conn_id, pkt_id, us, firing and the wanted data of every firing, over a table or a stream of decoded frames.

    Packets that the filter rules out by their own header are dropped first. A connection's packets are one task's work,
    as their order is what decides; tasks hold one connection's state. Over a stream, rows come in append mode, packets of
    a micro-batch are put in order, and a connection's state goes after its idle time by the watermark.
    """
    _deliverable(sub)
    kept = packets.where(sub.parsed.on_packets(packets.columns))
    return _delivered((_over_stream if packets.isStreaming else _over_table)(sub, kept, timeouts, until, late), sub)


def _over_table(sub: Subscription, packets: DataFrame, timeouts: Timeouts, until: Until | None, late: str) -> DataFrame:
    rows = packet_rows(packets).repartition(*KEY).sortWithinPartitions(*KEY, "us", "pkt_id")
    schema = to_arrow_schema(packets.sparkSession.createDataFrame([], _FULL).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import packetloom.parsers  # noqa: F401 registers the parsers on the executor

        key, state, out = None, None, []
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if r[:3] != key:
                    key, state = r[:3], Subscribed(sub, timeouts, until)
                row = state.packet(Packet(r[3], r[4], r[5], r[6], r[7], r[8], r[9], r[2], *r[10:]))
                if row:
                    out.append(row)
                    if len(out) >= 256:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.mapInArrow(run, _FULL)


class Whole:
    """Sessions as they are parsed and connections as they end, of one connection key; packets come in order."""

    def __init__(self, sub: Subscription, timeouts: Timeouts, most_out_of_order: int = 100):
        self.sub, self.timeouts, self.most = sub, timeouts, most_out_of_order
        self.no, self.seen, self.conn = 0, 0, None

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("sub", "timeouts")}

    def bound(self, sub: Subscription, timeouts: Timeouts) -> Whole:
        self.sub, self.timeouts = sub, timeouts
        return self

    def packet(self, p: Packet) -> list[dict]:
        out: list[dict] = []
        c = self.conn
        if c:
            window = self.timeouts.udp if p.proto == 17 else self.timeouts.establish if c.count == 1 else self.timeouts.tcp
            if p.us - c.us[2] > window:
                out += self.end("idle")
                c = None
        if c is None:
            if p.proto == 6 and p.flags & (SYN | ACK | RST) != SYN:
                return out
            c = self.conn = Connection(p, self.sub.protocols, self.most, "InterArrivals" in self.sub.datatypes or bool(_LISTS & set(self.sub.datatypes)))
        closed = c.add(p)
        return out + (self.end(closed) if closed else self._sessions(c, None))

    def end(self, how: str) -> list[dict]:
        """What is due when a connection ends: sessions left unfinished, and the connection."""
        c, self.conn = self.conn, None
        if c is None:
            return []
        row = c.row(how, self.no) | {"pkt_id": None, "us": c.us[2], "firing": None}
        out = self._sessions(c, row)
        self.no, self.seen = self.no + 1, 0
        if self.sub.level == Level.SESSION:
            return out
        service, f = row["service"], self.sub.parsed
        found = c.sessions if f.stage() == "session" else [(service, None)]
        wanted = next((x for d in self.sub.datatypes if (x := DATATYPES[d].protocol)), None)
        held = wanted is None or any(name == wanted for name, _ in c.sessions)
        return [row] if held and any(matches(f.tree, on_connection(_ends(c), name, s)) for name, s in found) else []

    def _sessions(self, c: Connection, ended: dict | None) -> list[dict]:
        if self.sub.level != Level.SESSION:
            return []
        new, at = c.sessions[self.seen :], self.seen
        self.seen = len(c.sessions)
        wanted = next(x for d in self.sub.datatypes if (x := DATATYPES[d].protocol))
        hits = [at + i for i, (name, s) in enumerate(new) if name == wanted and matches(self.sub.parsed.tree, on_connection(_ends(c), name, s))]
        if not hits:
            return []
        row = ended or c.row("open", self.no, ended=False) | {"pkt_id": None, "us": c.us[2], "firing": None}
        return [row | {"sessions": [row["sessions"][i]]} for i in hits]


def _ends(c: Connection) -> dict:
    p = c.first
    return {"ip_version": 4 if len(p.src_ip) == 4 else 6, "proto": p.proto, "orig_ip": p.src_ip, "resp_ip": p.dst_ip, "orig_port": p.src_port, "resp_port": p.dst_port}


def deliver_stream(sub: Subscription, packets: DataFrame, timeouts: Timeouts = Timeouts(), late: str = "10 minutes") -> DataFrame:
    """The rows of a subscription over a stream of decoded frames, as plans.subscribe.deliver() gives them over tables.

    Packets come as they pass the filter, sessions when they are parsed (conn_id, session_id), connections when they end by
    FIN, RST, or idle time, by the next packet of their ends or by the watermark (conn_id). Packets of connections that a
    later stage decides can't be had from a stream. Lists of packets hold ids. The watermark follows the packets that the
    filter keeps.
    """
    if sub.streaming:
        raise SubscriptionError("the subscription has a trigger: see firings()")
    f = sub.parsed
    if sub.level == Level.PACKET:
        if f.stage() != "packet":
            raise SubscriptionError("packets of connections that are decided later can't be had from a stream")
        return _project(packets.where(f.on_packets(packets.columns, exact=True)), sub, ["pkt_id"])
    left = [d for d in sub.datatypes if d in ("EthAddr", "EtherTCI", "SessionList")]
    if left:
        raise SubscriptionError(f"can't be had from a stream: {left}")
    kept = packets.where(f.on_packets(packets.columns))
    rows = connection_columns(_stateful(kept, late, timeouts, lambda blob: (pickle.loads(blob).bound(sub, timeouts) if blob else Whole(sub, timeouts)), lambda s: s.end("idle")))
    protocol = next((p for d in sub.datatypes if (p := DATATYPES[d].protocol)), None)
    if protocol:
        rows = rows.withColumn(protocol, F.get(F.filter("sessions", lambda x: x["protocol"] == protocol), F.lit(0))[protocol])
    if sub.level == Level.SESSION:
        return _project(rows.withColumn("session_id", F.get("sessions", F.lit(0))["session_no"]), sub, ["conn_id", "session_id"])
    return _project(rows, sub, ["conn_id"])


def _over_stream(sub: Subscription, packets: DataFrame, timeouts: Timeouts, until: Until | None, late: str) -> DataFrame:
    return _stateful(packets, late, timeouts, lambda blob: pickle.loads(blob).bound(sub, timeouts, until) if blob else Subscribed(sub, timeouts, until), lambda s: [])


def _plain(v: object) -> object:
    """A value as JSON can hold it: bytes in base64, maps as lists of entries."""
    if isinstance(v, bytes | bytearray):
        return base64.b64encode(v).decode()
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_plain({"key": x[0], "value": x[1]}) if isinstance(x, tuple) else _plain(x) for x in v]
    return v


def _stateful(packets: DataFrame, late: str, timeouts: Timeouts, load: Callable[[bytes | None], object], ended: Callable[[object], list[dict]]) -> DataFrame:
    """Rows in _FULL of a state machine for each connection key. load makes one from its kept state, ended gives what is due
    when the watermark has passed its idle time."""
    rows = packet_rows(packets, keep=["ts"]).withWatermark("ts", late)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import packetloom.parsers  # noqa: F401 registers the parsers on the executor

        s = load(state.get[0] if state.exists else None)
        out: list[dict] = []
        if state.hasTimedOut:
            out = ended(s)
            state.remove()
        else:
            last = 0
            for r in pd.concat(list(parts)).sort_values(["us", "pkt_id"]).itertuples(index=False):
                row = s.packet(Packet(int(r.pkt_id), int(r.us), bool(r.from_hi), bytes(r.src_ip), int(r.src_port), bytes(r.dst_ip), int(r.dst_port), int(key[2]), int(r.flags), int(r.seq), int(r.ack), int(r.len), int(r.frame_len), None if r.data is None else bytes(r.data)))
                last = max(last, int(r.us))
                out += row if isinstance(row, list) else [row] if row else []
            state.update((pickle.dumps(s),))
            idle = timeouts.udp if key[2] == 17 else timeouts.tcp
            state.setTimeoutTimestamp(max((last + idle) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"row": [json.dumps(_plain(x)) for x in out]}, dtype=object)

    fired = rows.groupBy(*KEY).applyInPandasWithState(step, "row string", "state binary", "append", GroupStateTimeout.EventTimeTimeout)
    entries = _FULL.replace("gaps: map<bigint, bigint>", "gaps: array<struct<key: bigint, value: bigint>>")
    full = fired.select(F.from_json("row", entries).alias("r")).select("r.*")
    mapped = lambda c: F.col(c).withField("gaps", F.map_from_entries(F.col(c)["gaps"]))
    return full.withColumns({c: mapped(c) for c in ("orig_flow", "resp_flow")})
