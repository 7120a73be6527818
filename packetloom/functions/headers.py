"""Frames to header columns: Ethernet with one 802.1Q tag, IPv4, IPv6, TCP and UDP, by Catalyst expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(frame: Column, offset: Column | int, size: int) -> Column:
    """The unsigned big-endian number at an offset; null if the frame ends before it."""
    at = F.lit(offset) if isinstance(offset, int) else offset
    part = F.substring(frame, at + 1, F.lit(size))
    return F.when(F.length(part) == size, F.conv(F.hex(part), 16, 10).cast("bigint"))


def _bits(c: Column, shift: int, mask: int) -> Column:
    return F.shiftright(c, shift).bitwiseAND(mask).cast("int")


def _level(df: DataFrame, made: dict[str, Column]) -> DataFrame:
    """df with columns that later ones build on. A row's struct comes out of a generator of one element, which the
    optimizer leaves whole; else it would write each column out wherever it is used, again and again."""
    kept = [c for c in df.columns if c not in made]
    one = F.explode(F.array(F.struct(*[c.alias(n) for n, c in made.items()]))).alias("__made")
    return df.select(*kept, one).select(*kept, *[F.col(f"__made.{n}").alias(n) for n in made])


#: Headers that users add: protocol to what makes its fields from the payload's place in the frame.
REGISTERED: dict[str, Callable[[Column, Column], dict[str, Column]]] = {}


def register_header(protocol: str, make: Callable[[Column, Column], dict[str, Column]]) -> None:
    """Adds a header above TCP or UDP: make(frame, offset) gives its fields, offset being where the payload begins. decode()
    then has a column protocol_field for each of them, null where a frame has no payload."""
    REGISTERED[protocol] = make


def decode(frames: DataFrame, frame: str = "frame", names: list[str] | None = None) -> DataFrame:
    """frames with the columns of the packet schema and of single header fields.

    Frames that are no IPv4 or IPv6 with TCP or UDP, have more than one VLAN tag, are cut inside the headers, or whose
    lengths contradict each other have null proto, payload_len and ports. IPv6 extension headers are not followed. Header
    columns are named protocol_field; names keeps only these. A null frame gives nulls.
    """
    f = F.col(frame)
    have = set(frames.columns)
    df = _level(frames, {"__type0": number(f, 12, 2)})
    tagged = F.col("__type0") == 0x8100
    df = _level(df, {"__l3": F.when(tagged, 18).otherwise(14), "vlan_tci": F.when(tagged, number(f, 14, 2)).cast("int"), "__type": F.when(tagged, number(f, 16, 2)).otherwise(F.col("__type0"))})
    l3 = F.col("__l3")
    v4, v6 = F.col("__type") == 0x0800, F.col("__type") == 0x86DD
    df = _level(df, {
        "ip_version": F.when(v4, 4).when(v6, 6), "__ihl": F.when(v4, number(f, l3, 1).bitwiseAND(15) * 4).when(v6, F.lit(40).cast("bigint")),
        "__next": F.when(v4, number(f, l3 + 9, 1)).when(v6, number(f, l3 + 6, 1)), "__l3len": F.when(v4, number(f, l3 + 2, 2)).when(v6, number(f, l3 + 4, 2) + 40),
        "total_length": F.when(v4, number(f, l3 + 2, 2)).cast("int"), "time_to_live": F.when(v4, number(f, l3 + 8, 1)).cast("int"),
        "src_ip": F.when(v4, F.substring(f, l3 + 13, F.lit(4))).when(v6, F.substring(f, l3 + 9, F.lit(16))),
        "dst_ip": F.when(v4, F.substring(f, l3 + 17, F.lit(4))).when(v6, F.substring(f, l3 + 25, F.lit(16))),
        "src_addr": F.when(v4, number(f, l3 + 12, 4)), "dst_addr": F.when(v4, number(f, l3 + 16, 4)),
    })
    tcp, udp = F.col("__next") == 6, F.col("__next") == 17
    l4 = (l3 + F.col("__ihl")).cast("int")
    df = _level(df, {"__l4": l4, "__off": F.when(tcp, F.shiftright(number(f, l4 + 12, 1), 4) * 4).when(udp, F.lit(8).cast("bigint")), "__end": number(f, l4 + F.when(tcp, 18).otherwise(6), 2)})
    l4 = F.col("__l4")
    size = F.col("__l3len") - F.col("__ihl") - F.col("__off")
    df = _level(df, {"__good": F.coalesce((size >= 0) & F.col("__end").isNotNull() & (F.col("__ihl") >= 20), F.lit(False)), "__len": size})
    good = F.col("__good")
    df = _level(df, {
        "proto": F.when(good, F.col("__next")).cast("int"), "src_port": F.when(good, number(f, l4, 2)).cast("int"), "dst_port": F.when(good, number(f, l4 + 2, 2)).cast("int"),
        "seq_no": F.when(good & tcp, number(f, l4 + 4, 4)).when(good, F.lit(0).cast("bigint")), "ack_no": F.when(good & tcp, number(f, l4 + 8, 4)).when(good, F.lit(0).cast("bigint")),
        "tcp_flags": F.when(good & tcp, number(f, l4 + 13, 1)).when(good, 0).cast("int"),
        "payload_off": F.when(good, l4 + F.col("__off")).cast("int"), "payload_len": F.when(good, F.col("__len")).cast("int"),
    })
    fields = _fields(f)
    for protocol, make in REGISTERED.items():
        there = F.col("payload_len") > 0
        fields |= {f"{protocol}_{n}": F.when(there, c) for n, c in make(f, F.col("payload_off")).items()}
    wanted = {n: c for n, c in fields.items() if names is None or n in names}
    # nothing builds on these, so a plain projection, which drops those that nobody asks for
    df = df.withColumns(wanted) if wanted else df
    if "frame_len" not in have:
        df = df.withColumn("frame_len", F.length(f))
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def _fields(f: Column) -> dict[str, Column]:
    """Every single header field, null where the frame has no such header."""
    l3, l4 = F.col("__l3"), F.col("__l4")
    four, six = F.col("ip_version") == 4, F.col("ip_version") == 6
    tcp, udp = F.col("proto") == 6, F.col("proto") == 17
    n4 = lambda o, s: F.when(four, number(f, l3 + o, s))
    n6 = lambda o, s: F.when(six, number(f, l3 + o, s))
    nt = lambda o, s: F.when(tcp, number(f, l4 + o, s))
    nu = lambda o, s: F.when(udp, number(f, l4 + o, s))
    out = {
        "eth_dst": F.substring(f, 1, 6), "eth_src": F.substring(f, 7, 6), "ether_type": F.col("__type").cast("int"),
        "ipv4_version": _bits(n4(0, 1), 4, 15), "ipv4_ihl": _bits(n4(0, 1), 0, 15), "ipv4_version_ihl": n4(0, 1), "ipv4_dscp": _bits(n4(1, 1), 2, 63), "ipv4_ecn": _bits(n4(1, 1), 0, 3),
        "ipv4_dscp_ecn": n4(1, 1), "ipv4_type_of_service": n4(1, 1), "ipv4_total_length": n4(2, 2), "ipv4_identification": n4(4, 2), "ipv4_flags_to_fragment_offset": n4(6, 2),
        "ipv4_flags": _bits(n4(6, 2), 13, 7), "ipv4_rf": _bits(n4(6, 2), 15, 1), "ipv4_df": _bits(n4(6, 2), 14, 1), "ipv4_mf": _bits(n4(6, 2), 13, 1), "ipv4_fragment_offset": _bits(n4(6, 2), 0, 0x1FFF),
        "ipv4_time_to_live": n4(8, 1), "ipv4_protocol": n4(9, 1), "ipv4_header_checksum": n4(10, 2), "ipv4_src_addr": n4(12, 4), "ipv4_dst_addr": n4(16, 4),
        "ipv6_version": _bits(n6(0, 1), 4, 15), "ipv6_traffic_class": _bits(n6(0, 2), 4, 255), "ipv6_dscp": _bits(n6(0, 2), 6, 63), "ipv6_ecn": _bits(n6(0, 2), 4, 3), "ipv6_flow_label": _bits(n6(0, 4), 0, 0xFFFFF),
        "ipv6_version_to_flow_label": n6(0, 4), "ipv6_payload_length": n6(4, 2), "ipv6_next_header": n6(6, 1), "ipv6_hop_limit": n6(7, 1),
        "tcp_src_port": nt(0, 2), "tcp_dst_port": nt(2, 2), "tcp_seq_no": nt(4, 4), "tcp_ack_no": nt(8, 4), "tcp_data_offset": _bits(nt(12, 1), 4, 15), "tcp_reserved": _bits(nt(12, 1), 1, 7),
        "tcp_data_offset_to_ns": nt(12, 1), "tcp_ns": _bits(nt(12, 1), 0, 1), "tcp_window": nt(14, 2), "tcp_checksum": nt(16, 2), "tcp_urgent_pointer": nt(18, 2),
        "udp_src_port": nu(0, 2), "udp_dst_port": nu(2, 2), "udp_length": nu(4, 2), "udp_checksum": nu(6, 2),
    }
    return out


def payload(frame: str = "frame") -> Column:
    """The bytes after the TCP or UDP header; null for other or truncated packets."""
    end = F.col("payload_off") + F.col("payload_len")
    return F.when(F.length(frame) >= end, F.substring(F.col(frame), F.col("payload_off") + 1, F.col("payload_len")))
