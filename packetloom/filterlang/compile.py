"""Filters as Catalyst columns, for the stage that is asked for.

A filter is decided on packets, on connections or on sessions. Each stage has the columns of FIELDS it can see; a conjunct
that needs a later stage is left out at an earlier one, so the earlier column lets more rows through, never fewer, and can
run before the shuffle by connection. A column is null where a value is missing, which counts as false: there is no
negation, so nothing turns it round, and comparisons stay bare enough to reach a parquet scan. holds() makes it two-valued. At connection and session stage src and dst mean originator and responder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.filterlang import fields as R
from packetloom.filterlang.ast import HEADERS, IntRange, Net, Op, Predicate
from packetloom.filterlang.errors import InvalidBinOp, InvalidField, InvalidHeader, InvalidPredType, InvalidRhsType
from packetloom.filterlang.normalize import Pattern, canonical
from packetloom.filterlang.parse import And, Or, Tree, parse
from packetloom.filterlang.regexes import to_jvm

_MAX_LONG = (1 << 63) - 1


def check(p: Predicate) -> None:
    """Raises if the field or the operator doesn't go with the protocol or value."""
    if p.unary:
        return
    if p.proto in HEADERS:
        if p.field not in R.HEADER_FIELDS.get(p.proto, ()):
            raise InvalidField(f"{p.proto}.{p.field}")
        kind = R.ADDR if p.field in ("src_addr", "dst_addr") else R.INT
    else:
        found = R.SESSION_FIELDS[p.proto].get(p.field)
        if not found:
            raise InvalidField(f"{p.proto}.{p.field}")
        kind = found[0]
    v, op = p.value, p.op
    if isinstance(v, IntRange):
        ops, ok = (Op.IN,), kind == R.INT
    elif isinstance(v, int):
        ops, ok = (Op.EQ, Op.NE, Op.GE, Op.LE, Op.GT, Op.LT), kind == R.INT
    elif isinstance(v, Net):
        ops, ok = (Op.EQ, Op.NE, Op.IN), kind == R.ADDR and (v.version == 4) == (p.proto == "ipv4")
    elif isinstance(v, bytes):
        ops, ok = (Op.EQ, Op.NE, Op.CONTAINS, Op.NOT_CONTAINS), kind in (R.BYTES, R.TEXT)
    else:
        ops = (Op.EQ, Op.NE, Op.RE, Op.BYTE_RE, Op.EN, Op.CONTAINS, Op.NOT_CONTAINS)
        ok = kind == R.TEXT or (kind == R.BYTES and op is Op.BYTE_RE)
    if op not in ops:
        raise InvalidBinOp(str(p))
    if not ok:
        raise InvalidRhsType(str(p))


def _long(n: int) -> Column:
    return F.lit(n).cast("bigint") if n <= _MAX_LONG else F.lit(n).cast("decimal(20,0)")


def compare(c: Column, p: Predicate, kind: str) -> Column:
    """The column of one comparison."""
    v, op = p.value, p.op
    if isinstance(v, IntRange):
        return c.between(_long(v.low), _long(v.high))
    if isinstance(v, int):
        n = _long(v)
        return {Op.EQ: c == n, Op.NE: c != n, Op.GE: c >= n, Op.LE: c <= n, Op.GT: c > n, Op.LT: c < n}[op]
    if isinstance(v, Net):
        ends = [F.lit(x).cast("bigint") if v.version == 4 else F.lit(x.to_bytes(16, "big")) for x in (v.low, v.high)]
        inside = c == ends[0] if v.low == v.high else c.between(*ends)
        return ~inside if op is Op.NE else inside
    if isinstance(v, bytes):
        data = c.cast("binary") if kind == R.TEXT else c
        return {Op.EQ: data == F.lit(v), Op.NE: data != F.lit(v), Op.CONTAINS: F.contains(data, F.lit(v)), Op.NOT_CONTAINS: ~F.contains(data, F.lit(v))}[op]
    if op is Op.RE:
        return c.rlike(to_jvm(v, False))
    if op is Op.BYTE_RE:
        return F.decode(c if kind == R.BYTES else c.cast("binary"), "ISO-8859-1").rlike(to_jvm(v, True))
    if op is Op.EN:
        return c == F.lit("".join(w[:1].upper() + w[1:] for w in v.split("_")))
    return {Op.EQ: c == F.lit(v), Op.NE: c != F.lit(v), Op.CONTAINS: F.contains(c, F.lit(v)), Op.NOT_CONTAINS: ~F.contains(c, F.lit(v))}[op]


def holds(c: Column) -> Column:
    """A filter's column as true or false, for use other than in where()."""
    return F.coalesce(c, F.lit(False))


class Filter:
    """A checked filter. text is kept as it was given, as it may itself be delivered."""

    def __init__(self, text: str = ""):
        self.text = text
        self.tree: Tree = parse(text)
        self.patterns: list[Pattern] = canonical(self.tree)
        for p in self.predicates():
            check(p)

    def predicates(self) -> list[Predicate]:
        return sorted({p for q in self.patterns for p in q}, key=lambda p: p.key)

    def protocols(self) -> set[str]:
        """Protocols above the transport layer, whose parsers are needed."""
        return {p.proto for p in self.predicates() if p.proto not in HEADERS}

    def stage(self) -> str:
        """The first stage that can decide the filter: packet, protocol or session."""
        ps = self.predicates()
        return "session" if any(p.on_session for p in ps) else "protocol" if any(p.on_proto for p in ps) else "packet"

    def per_packet(self) -> bool:
        """Whether it asks for fields that differ between packets of a connection."""
        return any(p.per_packet for p in self.predicates())

    def require_connection(self) -> None:
        if self.per_packet():
            raise InvalidPredType(f"fields of single packets can't select connections: {self.text}")

    def _column(self, decide: Callable[[Predicate], Column | None], exact: bool) -> Column:
        """The tree's column; predicates decided as None hold for now, or raise if the column must be exact."""

        def walk(t: Tree) -> Column | None:
            if isinstance(t, Predicate):
                return decide(t)
            if isinstance(t, And):
                parts = [c for c in map(walk, t.parts) if c is not None]
                return _fold(parts, lambda a, b: a & b) if parts else None
            if isinstance(t, Or):
                parts = [walk(x) for x in t.parts]
                return None if any(c is None for c in parts) else _fold(parts, lambda a, b: a | b)
            return F.lit(True)

        got = walk(self.tree)
        if got is None and exact:
            raise InvalidPredType(f"not decided at this stage: {self.text}")
        return F.lit(True) if got is None else got

    def on_packets(self, columns: list[str], exact: bool = False) -> Column:
        """The column for packet rows (the packet schema or decoded frames)."""
        have = set(columns)

        def decide(p: Predicate) -> Column | None:
            if p.proto not in HEADERS:
                carrier = {"quic": F.col("proto") == 17, "dns": F.col("proto").isin(6, 17)}.get(p.proto, F.col("proto") == 6)
                return None if p.proto in R.SESSION_FIELDS and exact else carrier
            layer = _layer(p.proto)
            if p.unary:
                return layer
            name = p.field
            if p.field in ("src_addr", "dst_addr") and p.proto == "ipv6":
                name = p.field.replace("addr", "ip")
            c = R.header_column(p.proto, name, have)
            if c is None:
                raise InvalidHeader(f"{p.proto}.{p.field} is in none of the columns")
            return layer & compare(c, p, R.ADDR if "addr" in p.field else R.INT)

        if exact and self.stage() != "packet":
            raise InvalidPredType(f"not decided by packets: {self.text}")
        return self._column(decide, exact)

    def on_connections(self, exact: bool = True, service: str = "service") -> Column:
        """The column for connection rows: ip_version, proto, orig_/resp_ addr (BIGINT), ip (BINARY), port, and service."""
        self.require_connection()

        def decide(p: Predicate) -> Column | None:
            if p.proto not in HEADERS:
                known = F.col(service) == p.proto
                return known if p.unary or not exact else None
            layer = _layer(p.proto)
            return layer if p.unary else layer & compare(F.col(_end(p)), p, R.ADDR)

        if exact and self.stage() == "session":
            raise InvalidPredType(f"not decided by connections: {self.text}")
        return self._column(decide, exact)

    def on_sessions(self, service: str = "protocol") -> Column:
        """The column for session rows: those of connections, protocol, and the struct of the session's protocol."""
        self.require_connection()

        def decide(p: Predicate) -> Column:
            if p.proto not in HEADERS:
                own = F.col(service) == p.proto
                if p.unary:
                    return own
                kind, made = R.SESSION_FIELDS[p.proto][p.field]
                return own & compare(made(), p, kind)
            layer = _layer(p.proto)
            return layer if p.unary else layer & compare(F.col(_end(p)), p, R.ADDR)

        return self._column(decide, True)


def operand(p: Predicate, stage: str, columns: list[str], service: str | None = None) -> tuple[Column, Column | None, str]:
    """What a predicate looks at, apart from its value: the condition of its layer, its field (None if unary), the kind.

    stage is packet, connection or session, whose columns the rows must have.
    """
    if p.proto in HEADERS:
        layer = _layer(p.proto)
        if p.unary:
            return layer, None, R.INT
        kind = R.ADDR if p.field in ("src_addr", "dst_addr") else R.INT
        if stage != "packet":
            return layer, F.col(_end(p)), kind
        name = p.field.replace("addr", "ip") if kind == R.ADDR and p.proto == "ipv6" else p.field
        c = R.header_column(p.proto, name, set(columns))
        if c is None:
            raise InvalidHeader(f"{p.proto}.{p.field} is in none of the columns")
        return layer, c, kind
    own = F.col(service or ("protocol" if stage == "session" else "service")) == p.proto
    if p.unary:
        return own, None, R.TEXT
    kind, made = R.SESSION_FIELDS[p.proto][p.field]
    return own, made(), kind


def _fold(parts: list[Column], op: Callable[[Column, Column], Column]) -> Column:
    out = parts[0]
    for c in parts[1:]:
        out = op(out, c)
    return out


def _layer(proto: str) -> Column:
    return {"ethernet": lambda: F.lit(True), "ipv4": lambda: F.col("ip_version") == 4, "ipv6": lambda: F.col("ip_version") == 6, "tcp": lambda: F.col("proto") == 6, "udp": lambda: F.col("proto") == 17}[proto]()


def _end(p: Predicate) -> str:
    end = "orig" if p.field.startswith("src") else "resp"
    return f"{end}_port" if p.field.endswith("port") else f"{end}_{'addr' if p.proto == 'ipv4' else 'ip'}"
