"""Frames of whole connections written from tables: what two ends say to each other, as bytes on the wire.

A connection has a number, which makes its client's address and port, and turns of bytes by either side. Everything is
built from columns, so tables of any size become traffic that decoding, tracing and parsing must read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16
#: Packet ids of one connection: its number times this, and the packet's place.
PLACES = 4096
#: Time of connection 0, and how far apart connections begin, in microseconds.
BEGIN_US, APART_US, STEP_US = 1_700_000_000_000_000, 20_000, 1_000
_SERVER = 0xC6120001  # 198.18.0.1
#: Bytes of a frame besides the payload.
HEAD = {6: 54, 17: 42}


def hexed(number: Column | str, size: int) -> Column:
    """A number as hexadecimal text of size bytes."""
    c = F.col(number) if isinstance(number, str) else number
    return F.lpad(F.hex(c.cast("bigint")), 2 * size, "0")


def block(text: Column, size: int) -> Column:
    """Hexadecimal text after its length in bytes, itself of size bytes."""
    return F.concat(hexed(F.expr("0") + F.length(text) / 2, size), text)


def ascii_hex(text: Column) -> Column:
    return F.hex(text.cast("binary"))


def turn(up: bool | Column, text: Column, at: Column | None = None, lost: Column | None = None) -> Column:
    """One turn: who speaks (the client up), what (hexadecimal text), the rank of its arrival and whether it gets lost."""
    way = F.lit(up) if isinstance(up, bool) else up
    return F.struct(way.alias("up"), F.unhex(text).alias("data"), (F.lit(None) if at is None else at).cast("int").alias("at"), (F.lit(False) if lost is None else lost).alias("lost"))


def conversation_of(ip: Column, port: Column) -> Column:
    """The number of a client's connection."""
    return F.shiftleft((port - 20000).cast("bigint"), 24) + F.conv(F.hex(F.substring(ip, 2, 3)), 16, 10).cast("bigint")


def _times(factor: int) -> Column:
    """conn times a factor of 32 bits, modulo 2^32, by halves of the factor: the product itself may need over 64 bits."""
    wrap = lambda x: F.pmod(x, F.lit(1 << 32).cast("bigint"))
    low = wrap(F.col("conn"))
    return wrap(wrap(low * (factor >> 16)) * (1 << 16) + low * (factor & 0xFFFF))


def frames_of(conversations: DataFrame, port: int, proto: int = 6) -> DataFrame:
    """pkt_id, ts, frame of every packet. conversations: conn BIGINT (0 to 2^39), turns ARRAY of turn(), close STRING.

    TCP opens with its handshake, and closes with FIN of both sides (close fin), RST of the client (rst), or not at all.
    Turns are sent in order; a turn with a rank arrives after so many others, a lost one never. UDP turns are datagrams.
    """
    zero = F.lit(0).cast("bigint")
    # bytes that each side has sent before each turn, and in all; columns of their own, so each is made once
    sums = lambda up: F.aggregate("turns", F.array(zero), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.when(x["up"] == F.lit(up), F.length(x["data"]).cast("bigint")).otherwise(zero))))
    c = conversations.select("conn", "turns", "close", F.size("turns").alias("n"), sums(True).alias("ups_at"), sums(False).alias("downs_at"))
    c = c.select(
        "*", F.element_at("ups_at", -1).alias("ups"), F.element_at("downs_at", -1).alias("downs"),
        _times(2654435761).alias("isn_up"), F.pmod(_times(40503) + 77777, F.lit(1 << 32).cast("bigint")).alias("isn_down"),
    )

    def segment(place: Column, at: Column, up: Column, flags: int, seq: Column, ack: Column, data: Column | None = None) -> Column:
        wrap = lambda x: F.pmod(x, F.lit(1 << 32).cast("bigint"))
        return F.struct(place.cast("bigint").alias("place"), at.cast("bigint").alias("at"), up.alias("up"), F.lit(flags).alias("flags"), wrap(seq).alias("seq"), (wrap(ack) if flags & ACK else zero).alias("ack"), (F.lit(b"") if data is None else data).alias("data"))

    own = lambda t: F.when(t["up"], F.col("isn_up")).otherwise(F.col("isn_down"))
    other = lambda t: F.when(t["up"], F.col("isn_down")).otherwise(F.col("isn_up"))
    said = lambda t, i, mine, theirs: F.when(t["up"], F.get(mine, i)).otherwise(F.get(theirs, i))
    sent = F.transform("turns", lambda t, i: F.struct(t.alias("t"), segment(i + 3, F.coalesce(t["at"], i) + 3, t["up"], PSH | ACK, own(t) + 1 + said(t, i, "ups_at", "downs_at"), other(t) + 1 + said(t, i, "downs_at", "ups_at"), t["data"]).alias("s")))
    kept = F.transform(F.filter(sent, lambda x: ~x["t"]["lost"]), lambda x: x["s"])
    if proto == 17:
        parts = kept
    else:
        i, n = F.lit(0), F.col("n")
        up, down = F.lit(True), F.lit(False)
        a, b = F.col("isn_up") + 1, F.col("isn_down") + 1
        opening = F.array(segment(i, i, up, SYN, F.col("isn_up"), zero), segment(i + 1, i + 1, down, SYN | ACK, F.col("isn_down"), a), segment(i + 2, i + 2, up, ACK, a, b))
        fin = F.array(segment(n + 3, n + 3, up, FIN | ACK, a + F.col("ups"), b + F.col("downs")), segment(n + 4, n + 4, down, FIN | ACK, b + F.col("downs"), a + F.col("ups") + 1), segment(n + 5, n + 5, up, ACK, a + F.col("ups") + 1, b + F.col("downs") + 1))
        rst = F.array(segment(n + 3, n + 3, up, RST, a + F.col("ups"), zero))
        parts = F.concat(opening, kept, F.when(F.col("close") == "fin", fin).when(F.col("close") == "rst", rst).otherwise(F.slice(rst, F.lit(1), F.lit(0))))
    p = c.select("conn", F.explode(parts).alias("p")).select("conn", "p.*")
    client, sport = hexed(F.lit(10 << 24) + F.pmod("conn", F.lit(1 << 24)), 4), hexed(20000 + F.shiftright("conn", 24), 2)
    server, dport = F.lit(f"{_SERVER:08X}"), F.lit(f"{port:04X}")
    ends = F.when(F.col("up"), F.concat(client, server)).otherwise(F.concat(server, client))
    ports = F.when(F.col("up"), F.concat(sport, dport)).otherwise(F.concat(dport, sport))
    head = HEAD[proto] - 14
    ip = F.concat(F.lit("02000000000102000000000A08004500"), hexed(F.length("data") + head, 2), F.lit(f"0000000040{proto:02X}0000"), ends, ports)
    l4 = F.concat(hexed("seq", 4), hexed("ack", 4), F.lit("50"), hexed("flags", 1), F.lit("040000000000")) if proto == 6 else F.concat(hexed(F.length("data") + 8, 2), F.lit("0000"))
    ts = F.timestamp_micros(F.lit(BEGIN_US) + F.col("conn") * APART_US + F.col("at") * STEP_US)
    return p.select((F.col("conn") * PLACES + F.col("place")).alias("pkt_id"), ts.alias("ts"), F.concat(F.unhex(F.concat(ip, l4)), "data").alias("frame"))
