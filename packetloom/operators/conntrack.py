"""Packets to connections: a key that is the same in both directions, expiry by idle time, orientation, features.

Nothing here sorts a connection as a whole. Packets are cut into cells of a few seconds, never longer than the idle time;
packets of one key in one cell always belong to one connection, so cells are aggregated first (ordered only within a cell)
and then joined up where the gap between them is no longer than the idle time. A flow that holds most packets is thus spread
over its cells. Packets are read once for the cells, by an aggregate that runs before the shuffle, and once more to be
given their connection, which moves each of them once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetloom.sources.tables import micros

FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16
#: Length of a cell in microseconds. Any up to the idle time gives the same result; short ones spread a hot flow.
CELL = 5_000_000


@dataclass(frozen=True)
class Timeouts:
    """Idle times in microseconds. offline: captures are read to the end without any expiry."""

    udp: int = 60_000_000
    tcp: int = 300_000_000
    establish: int = 5_000_000
    offline: bool = False

    def cell(self, us: Column) -> Column:
        """The cell that holds a time; idle times shorter than CELL have cells of their own length."""
        short = F.lit(CELL) if self.offline else F.least(F.lit(CELL).cast("bigint"), self.column())
        return us - F.pmod(us, short)

    def column(self) -> Column:
        return F.when(F.col("proto") == 17, F.lit(self.udp)).otherwise(F.lit(self.tcp)).cast("bigint")


def endpoint(ip: str, port: str) -> Column:
    """An address and port as bytes, of which the larger and the smaller make the key."""
    return F.concat(F.col(ip), F.unhex(F.lpad(F.hex(F.col(port).cast("bigint")), 4, "0")))


def with_key(packets: DataFrame) -> DataFrame:
    """packets with key_hi, key_lo BINARY and from_hi BOOLEAN; rows that are not TCP or UDP with ports are left out."""
    src, dst = endpoint("src_ip", "src_port"), endpoint("dst_ip", "dst_port")
    known = packets.where(F.col("proto").isin(6, 17) & F.col("src_port").isNotNull() & F.col("dst_port").isNotNull() & F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())
    return known.withColumns({"key_hi": F.greatest(src, dst), "key_lo": F.least(src, dst), "from_hi": src >= dst})


KEY = ["key_hi", "key_lo", "proto"]


def _letters() -> dict[str, Column]:
    """Events of a packet by letter, capital for the originator's side."""
    flags, n = F.coalesce("tcp_flags", F.lit(0)), F.coalesce("payload_len", F.lit(0))
    bit = lambda b: flags.bitwiseAND(b) != 0
    tcp = F.col("proto") == 6
    # in the order in which the letters of one packet are noted
    exact = lambda b: flags == b
    return {"S": tcp & exact(SYN), "H": tcp & exact(SYN | ACK), "A": tcp & exact(ACK) & (n == 0), "F": tcp & bit(FIN), "R": tcp & bit(RST), "D": n > 0}


_EVENTS = "SHAFRD"


def _sums(hi: bool) -> dict[str, Column]:
    own = F.col("from_hi") if hi else ~F.col("from_hi")
    tag = "hi" if hi else "lo"
    size = F.coalesce(F.col("payload_len"), F.lit(0)).cast("bigint")
    bad = F.col("payload_len").isNull() | (F.col("payload_len") < 0) | (F.col("payload_len") > F.col("frame_len"))
    return {
        f"n_{tag}": F.sum(F.when(own, 1).otherwise(0)), f"bytes_{tag}": F.sum(F.when(own, F.col("frame_len")).otherwise(0)),
        f"bad_{tag}": F.sum(F.when(own & bad, 1).otherwise(0)), f"payload_{tag}": F.sum(F.when(own & ~bad, size).otherwise(0)),
    }


def unordered() -> dict[str, Column]:
    """Aggregates of keyed packets (with us) that need no order: who opened, counters of both sides, first events."""
    seen = {}
    for tag, own in (("hi", F.col("from_hi")), ("lo", ~F.col("from_hi"))):
        for i, (letter, when) in enumerate(_letters().items()):
            seen[f"{letter}_{tag}"] = F.min(F.when(own & when, F.struct("us", "pkt_id", F.lit(i).alias("rank"))))
    opener = F.struct(F.struct("us", "pkt_id").alias("at"), F.col("from_hi").alias("from_hi"), F.col("src_ip").alias("ip"), F.col("src_port").alias("port"), F.col("dst_ip").alias("to_ip"), F.col("dst_port").alias("to_port"))
    return {"opener": F.min(opener), **_sums(True), **_sums(False), **seen}


def cells(packets: DataFrame, timeouts: Timeouts) -> DataFrame:
    """Aggregates of each key and cell: the mergeable partial result of connection features."""
    us = micros("ts")
    p = with_key(packets).withColumns({"us": us, "idle": timeouts.column()})
    p = p.where(F.col("us").isNotNull()).withColumn("cell", timeouts.cell(F.col("us")))
    w = W.partitionBy(*KEY, "cell").orderBy("us", "pkt_id")
    p = p.withColumns({"gap": F.col("us") - F.lag("us").over(w), "nth": F.row_number().over(w)})
    aggs = {
        "n": F.count(F.lit(1)), "bytes": F.sum(F.col("frame_len").cast("bigint")), "first_us": F.min("us"), "second_us": F.min(F.when(F.col("nth") == 2, F.col("us"))), "last_us": F.max("us"),
        "gap": F.coalesce(F.max("gap"), F.lit(0)), **unordered(),
    }
    return p.groupBy(*KEY, "idle", "cell").agg(*[c.alias(k) for k, c in aggs.items()])


def number_cells(parts: DataFrame, timeouts: Timeouts) -> DataFrame:
    """cells with conn_no, counting the connections of a key from 0 in the order of time, and the gap before each cell."""
    w = W.partitionBy(*KEY).orderBy("first_us")
    before = F.col("first_us") - F.lag("last_us").over(w)
    parts = parts.withColumn("before", before)
    new = F.when(F.col("before").isNull(), 0).when(F.lit(timeouts.offline), 0).when(F.col("before") > F.col("idle"), 1).otherwise(0)
    return parts.withColumn("__new", new).withColumn("conn_no", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))


def connections(packets: DataFrame, timeouts: Timeouts = Timeouts()) -> DataFrame:
    """One row for each connection with its features.

    Connections end by idle time only; those that begin with a SYN, end by FIN or RST, or have a time of their own to be
    established, come from trace_connections().

    packets: pkt_id (unique), ts, ip columns, ports, proto, frame_len, tcp_flags, payload_len. Rows without address,
    ports, time or another protocol are no part of any. Repeated packets must be dropped before. Result: key columns,
    conn_no, orig_/resp_ ip BINARY and port, first_us, second_us, last_us, duration_us, to_second_us, max_idle_us,
    pkt_count, byte_count, history, and for each side n_pkts, n_malformed, n_bytes, n_payload.
    """
    numbered = number_cells(cells(packets, timeouts), timeouts)
    mins = {f"{x}_{t}": F.min(f"{x}_{t}") for x in _EVENTS for t in ("hi", "lo")}
    sums = {f"{x}_{t}": F.sum(f"{x}_{t}") for x in ("n", "bytes", "bad", "payload") for t in ("hi", "lo")}
    # a connection's second packet is the second of its first cell, or the first of its second
    w = W.partitionBy(*KEY, "conn_no").orderBy("first_us")
    numbered = numbered.withColumn("nth", F.row_number().over(w))
    second = F.coalesce(F.min(F.when(F.col("nth") == 1, F.col("second_us"))), F.min(F.when(F.col("nth") == 2, F.col("first_us"))))
    inner = F.greatest(F.max("gap"), F.coalesce(F.max(F.when(F.col("nth") > 1, F.col("before"))), F.lit(0)))
    g = numbered.groupBy(*KEY, "conn_no").agg(F.sum("n").alias("pkt_count"), F.sum("bytes").alias("byte_count"), F.min("first_us").alias("first_us"), second.alias("second_us"), F.max("last_us").alias("last_us"), inner.alias("max_idle_us"), F.min("opener").alias("opener"), *[c.alias(k) for k, c in {**mins, **sums}.items()])
    more = ["second_us", F.coalesce(F.col("second_us") - F.col("first_us"), F.lit(0)).alias("to_second_us"), "max_idle_us"]
    return finished(g, more)


def finished(g: DataFrame, more: list[str | Column]) -> DataFrame:
    """Connections from aggregates of their packets (those of cells(), by the same names), with the columns more."""
    by_hi = F.col("opener.from_hi")
    notes = []
    for letter in _EVENTS:
        for mine, other, mark in (("hi", "lo", letter), ("lo", "hi", letter.lower())):
            at = F.when(by_hi, F.col(f"{letter}_{mine}")).otherwise(F.col(f"{letter}_{other}"))
            notes.append(F.when(at.isNotNull(), F.struct(at.alias("at"), F.lit(mark).alias("mark"))))
    history = F.array_join(F.transform(F.array_sort(F.filter(F.array(*notes), lambda x: x.isNotNull())), lambda x: x["mark"]), "")
    sides = {}
    for side, mine, other in (("orig", "hi", "lo"), ("resp", "lo", "hi")):
        for name, x in (("n_pkts", "n"), ("n_malformed", "bad"), ("n_bytes", "bytes"), ("n_payload", "payload")):
            sides[f"{side}_{name}"] = F.when(by_hi, F.col(f"{x}_{mine}")).otherwise(F.col(f"{x}_{other}"))
    return g.select(
        *KEY, *[c for c in ("conn_no",) if c in g.columns], F.col("opener.ip").alias("orig_ip"), F.col("opener.port").alias("orig_port"), F.col("opener.to_ip").alias("resp_ip"), F.col("opener.to_port").alias("resp_port"),
        "first_us", "last_us", (F.col("last_us") - F.col("first_us")).alias("duration_us"), *more, "pkt_count", "byte_count", history.alias("history"), *[c.alias(k) for k, c in sides.items()],
    )


def _parts(packets: DataFrame, timeouts: Timeouts, marks: dict[str, Column]) -> DataFrame:
    """What assign() needs to know of each cell; an aggregate without any order, so most of it happens before the shuffle."""
    p = with_key(packets).withColumns({"us": micros("ts"), "idle": timeouts.column()})
    p = p.where(F.col("us").isNotNull()).withColumn("cell", timeouts.cell(F.col("us")))
    side = lambda own: F.max(F.when(own, F.col("us")))
    return p.groupBy(*KEY, "idle", "cell").agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.min(F.struct("us", "pkt_id", "from_hi")).alias("opener"), F.count(F.lit(1)).alias("n"), F.sum(F.col("frame_len").cast("bigint")).alias("bytes"),
        side(F.col("from_hi")).alias("last_hi"), side(~F.col("from_hi")).alias("last_lo"), *[F.max(F.coalesce(c, F.lit(False))).alias(f"__m_{k}") for k, c in marks.items()],
    )


def assign(packets: DataFrame, timeouts: Timeouts = Timeouts(), marks: dict[str, Column] | None = None, numbers: bool = False) -> DataFrame:
    """packets with key columns, conn_no, and dir (true for packets of the originator).

    marks: conditions on packets by name; a column of each says whether any packet of the connection meets it. numbers:
    also nth (the packet's number in its connection, from 1), bytes_so_far, and gap_us (the time since the packet before
    it in its direction, null for the first): each is counted within the cell, on top of what earlier cells come to. Columns
    of these names are replaced. Packets without addresses, ports or time are left out, an empty table gives no rows.
    """
    marks = marks or {}
    packets = packets.drop("conn_no", "dir", *(["nth", "bytes_so_far", "gap_us"] if numbers else []), *marks)
    numbered = number_cells(_parts(packets, timeouts, marks), timeouts)
    conn = W.partitionBy(*KEY, "conn_no").orderBy("first_us")
    upto, earlier = conn.rowsBetween(W.unboundedPreceding, W.currentRow), conn.rowsBetween(W.unboundedPreceding, -1)
    more = {"__orig_hi": F.first("opener").over(upto)["from_hi"]}
    if numbers:
        more |= {"__n": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "__bytes": F.coalesce(F.sum("bytes").over(earlier), F.lit(0)), "__hi_us": F.max("last_hi").over(earlier), "__lo_us": F.max("last_lo").over(earlier)}
    more |= {k: F.max(f"__m_{k}").over(W.partitionBy(*KEY, "conn_no")) for k in marks}
    table = numbered.select(*[F.col(k).alias(f"__{k}") for k in KEY], F.col("cell").alias("__cell"), "conn_no", *[c.alias(k) for k, c in more.items()])
    p = with_key(packets).withColumn("__us", micros("ts"))
    p = p.where(F.col("__us").isNotNull()).withColumn("__c", timeouts.cell(F.col("__us")))
    # the table has few rows for each key; adaptive execution splits cells that hold very many packets
    on = (F.col("__c") == F.col("__cell")) & (F.col("key_hi") == F.col("__key_hi")) & (F.col("key_lo") == F.col("__key_lo")) & (F.col("proto") == F.col("__proto"))
    out = p.join(table, on).withColumn("dir", F.col("from_hi") == F.col("__orig_hi"))
    if numbers:
        cell = W.partitionBy("__c", *KEY).orderBy("__us", "pkt_id")
        way = W.partitionBy("__c", *KEY, "from_hi").orderBy("__us", "pkt_id")
        before = F.coalesce(F.lag("__us").over(way), F.when(F.col("from_hi"), F.col("__hi_us")).otherwise(F.col("__lo_us")))
        out = out.withColumns({"nth": F.col("__n") + F.row_number().over(cell), "bytes_so_far": F.col("__bytes") + F.sum(F.col("frame_len").cast("bigint")).over(cell.rowsBetween(W.unboundedPreceding, W.currentRow)), "gap_us": F.col("__us") - before})
    return out.drop("__us", "__c", "__cell", "__orig_hi", "__n", "__bytes", "__hi_us", "__lo_us", *[f"__{k}" for k in KEY])


def interarrivals(numbered: DataFrame) -> DataFrame:
    """Gaps in ns between packets of one direction, in order: key, conn_no, interarrivals_ctos, interarrivals_stoc.

    numbered: assign() with numbers. A list holds all gaps of its connection, so its row grows with the connection; for
    figures over gaps use gap_us itself, or gap_figures().
    """
    pair = F.struct("nth", (F.col("gap_us") * 1000).alias("g"))
    lists = numbered.groupBy(*KEY, "conn_no").agg(*[F.sort_array(F.collect_list(F.when((F.col("dir") == d) & F.col("gap_us").isNotNull(), pair))).alias(n) for n, d in (("c", True), ("s", False))])
    return lists.select(*KEY, "conn_no", F.col("c.g").alias("interarrivals_ctos"), F.col("s.g").alias("interarrivals_stoc"))


def gap_figures(numbered: DataFrame) -> DataFrame:
    """key, conn_no and for each direction the number, sum and largest of its gaps in ns, without any list."""
    ns = F.col("gap_us") * 1000
    aggs = {}
    for name, d in (("ctos", True), ("stoc", False)):
        own = F.when(F.col("dir") == d, ns)
        aggs |= {f"n_{name}": F.count(own), f"sum_{name}": F.coalesce(F.sum(own), F.lit(0)), f"max_{name}": F.coalesce(F.max(own), F.lit(0))}
    return numbered.groupBy(*KEY, "conn_no").agg(*[c.alias(k) for k, c in aggs.items()])


def packet_lists(assigned: DataFrame, item: str = "pkt_id") -> DataFrame:
    """key, conn_no, packets, packets_orig, packets_resp: the item (an id or the frame) of each packet in order of arrival.

    A list holds all packets of its connection, so its row grows with the connection.
    """
    one = F.struct(micros("ts").alias("us"), F.col("pkt_id").alias("no"), F.col(item).alias("v"))
    sides = {"packets": F.lit(True), "packets_orig": F.col("dir"), "packets_resp": ~F.col("dir")}
    lists = assigned.groupBy(*KEY, "conn_no").agg(*[F.sort_array(F.collect_list(F.when(c, one))).alias(n) for n, c in sides.items()])
    return lists.select(*KEY, "conn_no", *[F.col(f"{n}.v").alias(n) for n in sides])


#: Bytes of a stream whose spans are joined up together first; any number gives the same result.
BLOCK = 1 << 20


def content(assigned: DataFrame) -> DataFrame:
    """Final content of each direction by sequence number: key, conn_no, dir, n_chunks, content_gaps, missed_bytes.

    Islands of [start, end) relative to the first packet's sequence number, from which those that wrap are taken by their
    distance. Packets without payload hold no content. Spans are joined up within blocks of the stream first, then what is
    left of the blocks, so a direction with very many segments is never ordered as a whole.
    """
    size = F.coalesce("payload_len", F.lit(0))
    p = assigned.where((F.col("proto") == 6) & (size > 0) & F.col("seq_no").isNotNull())
    keys = [*KEY, "conn_no", "dir"]
    first = p.groupBy(*keys).agg(F.min_by("seq_no", F.struct(micros("ts"), "pkt_id")).alias("__base"))
    half, full = 1 << 31, 1 << 32
    p = p.join(first, keys)
    off = F.pmod(F.col("seq_no") - F.col("__base") + half, F.lit(full).cast("bigint")) - half
    spans = p.select(*keys, off.alias("s"), (off + size).alias("e")).withColumn("b", F.expr(f"s - pmod(s, {BLOCK})"))
    new = F.when(F.col("before").isNull() | (F.col("s") > F.col("before")), 1).otherwise(0)

    def islands(df: DataFrame, by: list[str]) -> DataFrame:
        w = W.partitionBy(*by).orderBy("s", "e")
        x = df.withColumn("before", F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))).withColumn("new", new)
        return x.withColumn("no", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))

    whole = islands(spans, [*keys, "b"]).groupBy(*keys, "b", "no").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("no", "b")
    w = W.partitionBy(*keys).orderBy("s", "e").rowsBetween(W.unboundedPreceding, -1)
    whole = whole.withColumn("before", F.max("e").over(w))
    return whole.groupBy(*keys).agg(F.sum(new).alias("n_chunks"), (F.sum(new) - 1).alias("content_gaps"), F.coalesce(F.sum(F.when(F.col("s") > F.col("before"), F.col("s") - F.col("before"))), F.lit(0)).alias("missed_bytes"))
