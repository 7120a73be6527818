"""Scalar functions on connections: subnets, display forms, sequence numbers, wire size."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions.addresses import ipv4_text

#: Bytes on the wire besides a frame: preamble, gap between packets, frame checksum. Fixed values.
PREAMBLE, GAP, CHECKSUM = 8, 12, 4


def ipv4_subnet(addr: Column) -> Column:
    """The /24 of an IPv4 number as text; broadcast and multicast addresses stay whole."""
    special = (addr == 0xFFFFFFFF) | F.shiftright(addr, 28).eqNullSafe(F.lit(14).cast("bigint"))
    return ipv4_text(F.when(special, addr).otherwise(addr.bitwiseAND(F.lit(0xFFFFFF00).cast("bigint"))))


def ipv6_subnet(ip: Column) -> Column:
    """The /64 of an IPv6 address, its first four groups in hex, followed by ::."""
    groups = [F.lower(F.regexp_replace(F.hex(F.substring(ip, 2 * i + 1, 2)), "^0{1,3}", "")) for i in range(4)]
    return F.concat(F.concat_ws(":", *groups), F.lit("::"))


def five_tuple_text(orig: Column, resp: Column, proto: Column) -> Column:
    return F.format_string("%s -> %s protocol %d", orig, resp, proto)


def transport_name(proto: Column) -> Column:
    """tcp or udp; none for another protocol or null."""
    return F.when(proto == 6, F.lit("tcp")).when(proto == 17, F.lit("udp")).otherwise(F.lit("none"))


def transport_text(orig_port: Column, resp_port: Column, proto: Column) -> Column:
    """JSON-like text of the transport: protocol, source and destination port."""
    return F.format_string('{"proto": "%s", "src": "%d", "dst": "%d"}', F.when(proto == 6, F.lit("tcp")).when(proto == 17, F.lit("udp")).otherwise(proto.cast("string")), orig_port, resp_port)


def wrapping_lt(left: Column, right: Column) -> Column:
    """left < right for sequence numbers that wrap at 2^32."""
    return F.pmod(left - right, F.lit(1 << 32).cast("bigint")) > F.lit(1 << 31).cast("bigint")


def wire_bits(frame_bytes: Column, packets: Column, with_checksum: bool = False) -> Column:
    return (frame_bytes + packets * (PREAMBLE + GAP + (CHECKSUM if with_checksum else 0))) * 8


def pretty(value: Column, unit: str) -> Column:
    """A number with one of the prefixes none, K, M, G, T and its unit."""
    size = F.abs(value.cast("double"))
    out = F.format_string(f"%.3f {unit}", value.cast("double"))
    for prefix, least in (("K", 1e3), ("M", 1e6), ("G", 1e9), ("T", 1e12)):
        out = F.when(size >= least, F.format_string(f"%.3f {prefix}{unit}", value.cast("double") / least)).otherwise(out)
    return out
