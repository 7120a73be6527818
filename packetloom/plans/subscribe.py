"""Subscriptions: a filter, the data wanted of what it lets through, and the grain at which rows are delivered."""

from __future__ import annotations

import tomllib
from collections.abc import Callable
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.filterlang import Filter
from packetloom.sources.traffic import Traffic


class Level(IntEnum):
    """Grain of delivery; of several data the highest holds."""

    STATIC = 0
    PACKET = 1
    SESSION = 2
    CONNECTION = 3


@dataclass(frozen=True)
class Datatype:
    """One kind of data: its level, the columns it needs, the protocol of a session."""

    level: Level
    make: Callable[[], Column]
    needs: tuple[str, ...] = ()
    protocol: str | None = None
    streamable: bool = False


def _struct(*names: str) -> Callable[[], Column]:
    return lambda: F.struct(*names)


def _session(protocol: str) -> Datatype:
    return Datatype(Level.SESSION, lambda: F.col(protocol), (protocol,), protocol)


def _packets(of: str, order: str) -> Datatype:
    """A list of packets; deliver() puts their frames in place of their ids."""
    name = {"bidir": "packets", "orig": "packets_orig", "resp": "packets_resp"}[of] + ("_reassembled" if order == "stream" else "")
    return Datatype(Level.CONNECTION, lambda: F.col(name), (name,), streamable=True)


_CONN = ("orig", "orig_port", "resp", "resp_port", "proto")
_RECORD = (*_CONN, "first_us", "last_us", "duration_us", "history", "pkt_count", "byte_count")
_MORE = ("second_us", "max_idle_us", "service", "orig_flow", "resp_flow")

DATATYPES: dict[str, Datatype] = {
    "ConnRecord": Datatype(Level.CONNECTION, _struct(*_RECORD), _RECORD, streamable=True),
    "ConnDuration": Datatype(Level.CONNECTION, lambda: F.expr("duration_us div 1000"), ("duration_us",), streamable=True),
    "PktCount": Datatype(Level.CONNECTION, lambda: F.col("pkt_count"), ("pkt_count",), streamable=True),
    "ByteCount": Datatype(Level.CONNECTION, lambda: F.col("byte_count"), ("byte_count",), streamable=True),
    "InterArrivals": Datatype(Level.CONNECTION, _struct("interarrivals_ctos", "interarrivals_stoc"), ("interarrivals_ctos", "interarrivals_stoc"), streamable=True),
    "ConnHistory": Datatype(Level.CONNECTION, lambda: F.col("history"), ("history",), streamable=True),
    "HttpTransaction": _session("http"), "DnsTransaction": _session("dns"), "TlsHandshake": _session("tls"), "QuicStream": _session("quic"), "SshHandshake": _session("ssh"),
    "ZcFrame": Datatype(Level.PACKET, lambda: F.col("frame"), ("frame",)), "Payload": Datatype(Level.PACKET, lambda: F.expr("substring(frame, payload_off + 1, payload_len)"), ("frame", "payload_off", "payload_len")),
    "SessionList": Datatype(Level.CONNECTION, lambda: F.col("sessions"), ()),
    "BidirPktStream": _packets("bidir", "arrival"), "OrigPktStream": _packets("orig", "arrival"), "RespPktStream": _packets("resp", "arrival"),
    "BidirZcPktStream": _packets("bidir", "arrival"), "OrigZcPktStream": _packets("orig", "arrival"), "RespZcPktStream": _packets("resp", "arrival"),
    "OrigPktsReassembled": _packets("orig", "stream"), "RespPktsReassembled": _packets("resp", "stream"), "OrigZcPktsReassembled": _packets("orig", "stream"), "RespZcPktsReassembled": _packets("resp", "stream"),
    "CoreId": Datatype(Level.STATIC, F.spark_partition_id), "FiveTuple": Datatype(Level.STATIC, _struct(*_CONN), _CONN),
    "EtherTCI": Datatype(Level.STATIC, lambda: F.col("vlan_tci"), ("vlan_tci",)), "EthAddr": Datatype(Level.STATIC, _struct("eth_src", "eth_dst"), ("eth_src", "eth_dst")),
    "FilterStr": Datatype(Level.STATIC, lambda: F.lit(None).cast("string")),
}


def register_datatype(name: str, datatype: Datatype) -> None:
    """Adds a kind of data that subscriptions may ask for."""
    DATATYPES[name] = datatype


class SubscriptionError(ValueError):
    """A subscription whose data don't go together."""


@dataclass(frozen=True)
class Subscription:
    """streaming: None, or ('packets' | 'bytes' | 'seconds', number)."""

    filter: str
    datatypes: tuple[str, ...]
    name: str = "callback"
    streaming: tuple[str, float] | None = None
    parsed: Filter = field(init=False, compare=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "datatypes", tuple(self.datatypes))
        object.__setattr__(self, "parsed", Filter(self.filter))
        unknown = [d for d in self.datatypes if d not in DATATYPES]
        if unknown or not self.datatypes:
            raise SubscriptionError(f"unknown data: {unknown}" if unknown else "no data wanted")
        levels = [DATATYPES[d].level for d in self.datatypes]
        packets, sessions = levels.count(Level.PACKET), levels.count(Level.SESSION)
        if packets > 1 or sessions > 1:
            raise SubscriptionError("at most one packet and one session datatype")
        if packets and max(levels) > Level.PACKET:
            raise SubscriptionError("packet data go with static data only")
        if self.streaming:
            unit, n = self.streaming
            if unit not in ("packets", "bytes", "seconds") or n <= 0:
                raise SubscriptionError(f"streaming: {self.streaming}")
            if sum(DATATYPES[d].streamable for d in self.datatypes) != 1 or packets:
                raise SubscriptionError("streaming needs exactly one datatype that can be streamed")
        if not packets:
            self.parsed.require_connection() if self.parsed.stage() != "packet" or self.level != Level.STATIC else None

    @property
    def level(self) -> Level:
        return max(DATATYPES[d].level for d in self.datatypes)

    @property
    def protocols(self) -> set[str]:
        """Protocols to be parsed for it."""
        return self.parsed.protocols() | {p for d in self.datatypes if (p := DATATYPES[d].protocol)}

    @property
    def needs(self) -> set[str]:
        """Columns that its data are made of, for traffic_from_frames()."""
        own = {n for d in self.datatypes for n in DATATYPES[d].needs}
        return own | ({*_MORE} if "ConnRecord" in self.datatypes else set()) | ({"packet_ids"} if self.level == Level.PACKET else set())


def load_subscriptions(path: str) -> list[Subscription]:
    """Subscriptions of a TOML file: [[subscriptions]] with filter, datatypes (one or many), callback, streaming."""
    with open(path, encoding="utf-8") as f:
        return read_subscriptions(f.read())


def read_subscriptions(text: str) -> list[Subscription]:
    """Subscriptions of a TOML text, see load_subscriptions()."""
    out = []
    for s in tomllib.loads(text).get("subscriptions", []):
        wanted = s["datatypes"]
        stream = s.get("streaming")
        unit = next(((k.lower(), v) for k, v in stream.items()), None) if stream else None
        out.append(Subscription(s.get("filter", ""), tuple([wanted] if isinstance(wanted, str) else wanted), s.get("callback", "callback"), unit))
    return out


def _project(rows: DataFrame, sub: Subscription, keys: list[str]) -> DataFrame:
    missing = {n for d in sub.datatypes for n in DATATYPES[d].needs} - set(rows.columns)
    if missing:
        raise SubscriptionError(f"the traffic has no columns {sorted(missing)}")

    def made(d: str) -> Column:
        if d == "FilterStr":
            return F.lit(sub.filter)
        if d == "ConnRecord":  # with what else is known of the connection
            return F.struct(*_RECORD, *[c for c in _MORE if c in rows.columns])
        return DATATYPES[d].make()

    return rows.select(*keys, *[made(d).alias(d) for d in sub.datatypes])


def continue_packets(packets: DataFrame, filters: list[Filter]) -> DataFrame:
    """Packets that at least one of the filters may still want, each judged by its own header.

    Connections made from these are what all subscriptions together see; connections made from those of one filter are
    what it sees alone.
    """
    if not filters:
        return packets.limit(0)
    any_ = F.lit(False)
    for f in filters:
        any_ = any_ | f.on_packets(packets.columns)
    return packets.where(any_)


def deliver(sub: Subscription, traffic: Traffic) -> DataFrame:
    """The rows of one subscription, evaluated as if it were alone.

    Packet level: one row a packet (pkt_id, conn_id if known). Session level: one row a session (conn_id, session_id).
    Connection and static level: one row a connection (conn_id). Lists of packets hold their frames, in order of arrival or
    of the reassembled stream; a row with such a list grows with its connection.
    """
    f, level = sub.parsed, sub.level
    if level == Level.PACKET:
        packets = traffic.packets
        if packets is None:
            raise SubscriptionError("the traffic has no packets")
        keys = [c for c in ("conn_id", "pkt_id") if c in packets.columns]
        if f.stage() == "packet":
            return _project(packets.where(f.on_packets(packets.columns, exact=True)), sub, keys)
        return _project(packets.join(_matched(f, traffic), "conn_id", "left_semi"), sub, keys)
    protocol = next((p for d in sub.datatypes if (p := DATATYPES[d].protocol)), None)
    ends = [c for c in traffic.connections.columns if c not in traffic.sessions.columns or c == "conn_id"]
    if level == Level.SESSION:
        rows = _session_rows(traffic, ends).where(F.col("protocol") == protocol)
        return _project(rows.where(f.on_sessions()), sub, ["conn_id", "session_id"])
    conns = traffic.connections if traffic.whole is None else traffic.whole
    conns = conns.where(f.on_connections()) if f.stage() != "session" else conns.join(_matched(f, traffic), "conn_id", "left_semi")
    if protocol and traffic.whole is not None:  # as below; sessions come in their order
        conns = conns.withColumn(protocol, F.get(F.filter("sessions", lambda s: s["protocol"] == protocol), F.lit(0))).where(F.col(protocol).isNotNull()).withColumn(protocol, F.col(protocol)[protocol])
    elif protocol:  # the first session of the protocol, whether or not it is the one that matched
        first = traffic.sessions.where(F.col("protocol") == protocol).groupBy("conn_id").agg(F.min_by(protocol, "session_id").alias(protocol))
        conns = conns.join(first, "conn_id")
    if "SessionList" in sub.datatypes and traffic.whole is not None:
        names = [c for c in traffic.sessions.columns if c not in ("conn_id", "session_id")]
        text = lambda s: F.to_json(F.struct(s["session_no"].alias("session_id"), *[s[n].alias(n) for n in names]))
        conns = conns.withColumn("sessions", F.coalesce(F.transform("sessions", text), F.array().cast("array<string>")))
    elif "SessionList" in sub.datatypes:
        structs = [c for c in traffic.sessions.columns if c != "conn_id"]
        lists = traffic.sessions.groupBy("conn_id").agg(F.sort_array(F.collect_list(F.struct("session_id", F.to_json(F.struct(*structs)).alias("session")))).alias("sessions"))
        conns = conns.join(lists, "conn_id", "left").withColumn("sessions", F.coalesce(F.col("sessions.session"), F.array().cast("array<string>")))
    return _project(_with_frames(conns, sub, traffic), sub, ["conn_id"])


_LISTS = ("packets", "packets_orig", "packets_resp", "packets_orig_reassembled", "packets_resp_reassembled")


def _with_frames(conns: DataFrame, sub: Subscription, traffic: Traffic) -> DataFrame:
    """conns with frames (ARRAY<BINARY>) instead of ids in the lists of packets that are wanted, in the lists' order."""
    wanted = sorted({n for d in sub.datatypes for n in DATATYPES[d].needs if n in _LISTS})
    source = traffic.packets if traffic.frames is None else traffic.frames
    if not wanted or source is None or "frame" not in source.columns:
        return conns
    # merged, as what Spark expects of lists and of headers made from frames is far too small to broadcast by
    frames = source.select(F.col("pkt_id").alias("__id"), F.col("frame").alias("__frame")).hint("merge")
    ids = None
    for n in wanted:
        one = conns.select(F.col("conn_id").alias("__conn"), F.lit(n).alias("__list"), F.posexplode(n).alias("__at", "__id"))
        ids = one if ids is None else ids.unionByName(one)
    placed = F.struct("__at", "__frame")
    lists = ids.join(frames, "__id").groupBy("__conn").agg(*[F.sort_array(F.collect_list(F.when(F.col("__list") == n, placed))).alias(f"__f_{n}") for n in wanted])
    out = conns.join(lists.hint("merge"), F.col("conn_id") == F.col("__conn"), "left").drop("__conn")
    return out.withColumns({n: F.coalesce(F.col(f"__f_{n}.__frame"), F.array().cast("array<binary>")) for n in wanted}).drop(*[f"__f_{n}" for n in wanted])


def _matched(f: Filter, traffic: Traffic) -> DataFrame:
    """conn_id of the connections a filter matches."""
    if f.stage() != "session":
        return traffic.connections.where(f.on_connections()).select("conn_id")
    ends = [c for c in traffic.connections.columns if c not in traffic.sessions.columns or c == "conn_id"]
    return _session_rows(traffic, ends).where(f.on_sessions()).select("conn_id").distinct()


def _session_rows(traffic: Traffic, ends: list[str]) -> DataFrame:
    """Sessions with the columns of their connections."""
    if traffic.whole is None:
        return traffic.sessions.join(traffic.connections.select(*ends), "conn_id")
    own = [c for c in traffic.sessions.columns if c not in ("conn_id", "session_id")]
    return traffic.whole.select(*ends, F.explode("sessions").alias("__s")).select(*ends, F.col("__s.session_no").alias("session_id"), *[F.col(f"__s.{c}").alias(c) for c in own])


def deliver_all(subs: list[Subscription], traffic: Traffic) -> dict[str, DataFrame]:
    """Rows by callback. Subscriptions with the same callback and data deliver a row once, unless they want FilterStr."""
    out: dict[str, DataFrame] = {}
    groups: dict[tuple, list[Subscription]] = {}
    for s in subs:
        groups.setdefault((s.name, s.datatypes), []).append(s)
    for (name, wanted), same in groups.items():
        parts = [deliver(s, traffic) for s in same]
        keys = [c for c in ("conn_id", "session_id", "pkt_id") if c in parts[0].columns]
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if len(parts) > 1 and "FilterStr" not in wanted:
            rows = rows.dropDuplicates(keys)
        out[name if name not in out else f"{name}({', '.join(wanted)})"] = rows
    return out
