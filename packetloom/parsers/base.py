"""What a parser of an application protocol does, and how the protocol of a connection is found out."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum


class Probe(Enum):
    CERTAIN = 1
    UNSURE = 2
    NOT_FOR_US = 3


class Truncated(ValueError):
    """The bytes end before the message does."""


class Parser:
    """State of one connection. Sessions are dicts in the shape of the protocol's struct."""

    protocol = ""
    #: Bytes thrown away because a message outgrew its buffer.
    lost = 0

    def probe(self, data: bytes, to_server: bool, ports: tuple[int, int], udp: bool) -> Probe:
        raise NotImplementedError

    def feed(self, data: bytes, to_server: bool) -> list[dict]:
        """Takes the next bytes of one direction, in order; the sessions they complete."""
        raise NotImplementedError

    def drain(self) -> list[dict]:
        """Sessions left unfinished when the connection ends."""
        return []


class Reader:
    """Big-endian fields of bytes."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise Truncated(f"{n} bytes at {self.at} of {len(self.data)}")
        self.at += n
        return self.data[self.at - n : self.at]

    def uint(self, n: int) -> int:
        return int.from_bytes(self.take(n), "big")

    def block(self, n: int) -> bytes:
        """Bytes after a length of n bytes."""
        return self.take(self.uint(n))

    @property
    def left(self) -> int:
        return len(self.data) - self.at


PARSERS: dict[str, Callable[[], Parser]] = {}


def register(make: type[Parser]) -> type[Parser]:
    """Adds a parser; users may add their own."""
    PARSERS[make.protocol] = make
    return make


class Prober:
    """Finds the one parser that is certain, in the order of names; none once all refuse."""

    def __init__(self, protocols: set[str], ports: tuple[int, int], udp: bool):
        self.open = {p: PARSERS[p]() for p in sorted(protocols)}
        self.all = list(self.open.values())
        self.ports, self.udp = ports, udp
        self.seen: list[tuple[bytes, bool]] = []
        self.parser: Parser | None = None

    def feed(self, data: bytes, to_server: bool) -> list[dict]:
        if self.parser:
            return self.parser.feed(data, to_server)
        if not data or not self.open:
            return []
        self.seen.append((data, to_server))
        for name, p in list(self.open.items()):
            said = p.probe(data, to_server, self.ports, self.udp)
            if said is Probe.CERTAIN:
                self.parser = p
                out = [s for d, way in self.seen for s in p.feed(d, way)]
                self.seen.clear()
                return out
            if said is Probe.NOT_FOR_US:
                del self.open[name]
        return []

    def drain(self) -> list[dict]:
        return self.parser.drain() if self.parser else []
