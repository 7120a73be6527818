"""Predicates, values and the graph of protocols."""

from __future__ import annotations

import ipaddress
import dataclasses
from dataclasses import dataclass
from enum import StrEnum

from packetloom.filterlang.errors import InvalidProtocol

#: Which protocols may stand on top of which. Fixed values.
GRAPH: dict[str, tuple[str, ...]] = {
    "ethernet": ("ipv4", "ipv6"),
    "ipv4": ("tcp", "udp"),
    "ipv6": ("tcp", "udp"),
    "tcp": ("tls", "http", "dns", "ssh"),
    "udp": ("dns", "quic"),
    "tls": (), "http": (), "dns": (), "ssh": (), "quic": (),
}
HEADERS = frozenset(("ethernet", "ipv4", "ipv6", "tcp", "udp"))
SESSIONS = frozenset(GRAPH) - HEADERS
#: Header fields that stay the same for all packets of a connection.
CONNECTION_FIELDS = frozenset(("src_addr", "dst_addr", "src_port", "dst_port"))


class Op(StrEnum):
    EQ = "="
    NE = "!="
    GE = ">="
    LE = "<="
    GT = ">"
    LT = "<"
    IN = "in"
    RE = "~"
    BYTE_RE = "~b"
    EN = "eq"
    CONTAINS = "contains"
    NOT_CONTAINS = "not contains"


@dataclass(frozen=True, order=True)
class IntRange:
    low: int
    high: int


@dataclass(frozen=True)
class Net:
    """An address or a prefix, kept with the host bits cleared."""

    version: int
    low: int
    prefix: int

    @property
    def high(self) -> int:
        return self.low | ((1 << self.bits - self.prefix) - 1)

    @property
    def bits(self) -> int:
        return 32 if self.version == 4 else 128

    def holds(self, other: Net) -> bool:
        return self.version == other.version and self.low <= other.low and other.high <= self.high

    def __str__(self) -> str:
        kind = ipaddress.IPv4Address if self.version == 4 else ipaddress.IPv6Address
        return f"{kind(self.low)}/{self.prefix}"


Value = int | IntRange | Net | str | bytes


def _order(value: Value | None) -> tuple[str, str]:
    return (type(value).__name__, str(value) if not isinstance(value, int) else f"{value:020d}")


@dataclass(frozen=True)
class Predicate:
    """proto, or proto.field op value."""

    proto: str
    field: str | None = None
    op: Op | None = None
    value: Value | None = None
    key: tuple = dataclasses.field(init=False, compare=False, repr=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "key", (self.proto, self.field or "", self.op or "", _order(self.value)))

    @property
    def unary(self) -> bool:
        return self.field is None

    @property
    def on_packet(self) -> bool:
        return self.proto in HEADERS

    @property
    def on_proto(self) -> bool:
        return self.proto in SESSIONS and self.unary

    @property
    def on_session(self) -> bool:
        return self.proto in SESSIONS and not self.unary

    @property
    def per_packet(self) -> bool:
        """Whether it asks for a header field that differs between packets of a connection."""
        return self.proto in HEADERS and not self.unary and self.field not in CONNECTION_FIELDS

    def __str__(self) -> str:
        if self.unary:
            return self.proto
        v = self.value
        text = f"{v.low}..{v.high}" if isinstance(v, IntRange) else f"|{v.hex(' ')}|" if isinstance(v, bytes) else f"'{v}'" if isinstance(v, str) else str(v)
        return f"{self.proto}.{self.field} {self.op} {text}"


def reaches(low: str, high: str) -> bool:
    """Whether high may stand somewhere on top of low."""
    if low not in GRAPH or high not in GRAPH:
        raise InvalidProtocol(low if low not in GRAPH else high)
    return any(n == high or reaches(n, high) for n in GRAPH[low])


def chains(top: str | None = None) -> list[tuple[str, ...]]:
    """All chains of protocols from ethernet upward; those that end in top, if it is given."""
    out, todo = [], [("ethernet",)]
    while todo:
        c = todo.pop()
        out.append(c)
        todo += [(*c, n) for n in GRAPH[c[-1]]]
    return sorted(c for c in out if top is None or c[-1] == top)
