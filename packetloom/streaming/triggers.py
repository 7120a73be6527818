"""Callbacks while a connection goes on: every N packets, bytes or seconds, from the first packet on.

A trigger fires at the first packet, then whenever its count runs out: after N more packets; when N bytes have passed,
where what is over doesn't count for the next time; or at the first packet at least S seconds after the last firing.
Counters are cumulative. until ends the subscription of a connection once it is true of its counters at a firing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetloom.operators.conntrack import KEY, Timeouts, assign, with_key
from packetloom.plans.subscribe import Subscription, SubscriptionError
from packetloom.sources.tables import micros

OUT = "key_hi binary, key_lo binary, proto int, conn_no int, pkt_id bigint, us bigint, pkt_count bigint, byte_count bigint, firing int"
_STATE = "conn_no int, last_us bigint, pkts bigint, bytes bigint, left double, fired_us bigint, firings int, stopped boolean"
Until = Callable[[int, int], bool]


class Trigger:
    """State of one connection key; rows come in order of time."""

    def __init__(self, unit: str, n: float, timeouts: Timeouts, until: Until | None):
        if unit not in ("packets", "bytes", "seconds") or n <= 0:
            raise ValueError(f"trigger {unit} = {n}")
        self.unit, self.n, self.timeouts, self.until = unit, n, timeouts, until
        self.reset(0)

    def reset(self, conn_no: int) -> None:
        self.conn_no, self.last_us, self.pkts, self.bytes, self.left, self.fired_us, self.firings, self.stopped = conn_no, None, 0, 0, 0.0, None, 0, False

    def state(self) -> tuple:
        return (self.conn_no, self.last_us, self.pkts, self.bytes, self.left, self.fired_us, self.firings, self.stopped)

    def load(self, s: tuple) -> None:
        self.conn_no, self.last_us, self.pkts, self.bytes, self.left, self.fired_us, self.firings, self.stopped = s

    def packet(self, us: int, size: int, udp: bool) -> bool:
        """Whether it fires at this packet."""
        idle = self.timeouts.udp if udp else self.timeouts.tcp
        if self.last_us is not None and us - self.last_us > idle and not self.timeouts.offline:
            self.reset(self.conn_no + 1)
        self.last_us = us if self.last_us is None else max(self.last_us, us)
        self.pkts += 1
        self.bytes += size
        if self.stopped:
            return False
        if self.fired_us is None:
            fires = True
        elif self.unit == "seconds":
            fires = us - self.fired_us >= self.n * 1e6
        else:
            self.left -= 1 if self.unit == "packets" else size
            fires = self.left <= 0
        if fires:
            self.left, self.fired_us = float(self.n), us
            self.firings += 1
            self.stopped = bool(self.until and self.until(self.pkts, self.bytes))
        return fires


def _rows(packets: DataFrame) -> DataFrame:
    return with_key(packets).select(*KEY, "pkt_id", micros("ts").alias("us"), F.col("frame_len").cast("bigint").alias("size"), "ts")


def batch_triggers(packets: DataFrame, unit: str, n: float, timeouts: Timeouts = Timeouts(), until: Until | None = None) -> DataFrame:
    """Firings over a table of packets. Every N packets is a matter of numbers, which are counted by cells, so a flow that
    holds most packets is spread. What bytes, seconds or until decide depends on the firings before: there tasks stream
    through sorted packets and hold one connection's counters, and a flow is one task's."""
    if unit == "packets" and until is None and n == int(n) and n > 0:
        p = assign(packets, timeouts, numbers=True).where(F.pmod(F.col("nth") - 1, F.lit(int(n))) == 0)
        return p.select(*KEY, F.col("conn_no").cast("int").alias("conn_no"), "pkt_id", micros("ts").alias("us"), F.col("nth").cast("bigint").alias("pkt_count"), F.col("bytes_so_far").alias("byte_count"), (F.expr(f"(nth - 1) div {int(n)}") + 1).cast("int").alias("firing"))
    rows = _rows(packets).drop("ts").where("us is not null").repartition(*KEY).sortWithinPartitions(*KEY, "us", "pkt_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, t = None, Trigger(unit, n, timeouts, until)
        types = [pa.binary(), pa.binary(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.int32()]
        names = [x.split()[0] for x in OUT.split(", ")]
        for b in batches:
            out = []
            for hi, lo, proto, pkt_id, us, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (hi, lo, proto) != key:
                    key = (hi, lo, proto)
                    t.reset(0)
                if t.packet(us, size or 0, proto == 17):
                    out.append((hi, lo, proto, t.conn_no, pkt_id, us, t.pkts, t.bytes, t.firings))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, y) for c, y in zip(zip(*out, strict=True), types, strict=True)], names)

    return rows.mapInArrow(run, OUT)


def deliver_firings(sub: Subscription, packets: DataFrame, timeouts: Timeouts = Timeouts(), until: Until | None = None) -> DataFrame:
    """Firings of a subscription to counters whose filter packets decide, over a table or a stream of packets without
    their payload. Others come from subscribed.firings(), which follows the content.

    Besides the columns of OUT: FilterStr, and the wanted PktCount or ByteCount. Packets are filtered before they are
    counted, each by its own header.
    """
    if not sub.streaming:
        raise SubscriptionError("the subscription has no trigger")
    unit, n = sub.streaming
    named = {"PktCount": F.col("pkt_count"), "ByteCount": F.col("byte_count"), "FilterStr": F.lit(sub.filter)}
    if left := [d for d in sub.datatypes if d not in named]:
        raise SubscriptionError(f"no counters: {left}")
    kept = packets.where(sub.parsed.on_packets(packets.columns, exact=True))
    fired = (stream_triggers if packets.isStreaming else batch_triggers)(kept, unit, n, timeouts, until)
    return fired.select("*", *[c.alias(k) for k, c in named.items() if k in sub.datatypes])


def stream_triggers(packets: DataFrame, unit: str, n: float, timeouts: Timeouts = Timeouts(), until: Until | None = None, late: str = "10 minutes") -> DataFrame:
    """Firings over a stream, in append mode. State of a key goes after its idle time by the watermark; packets of one
    micro-batch are put in order, packets older than the state's last are counted where they arrive."""
    rows = _rows(packets).withWatermark("ts", late)
    names = [x.split()[0] for x in OUT.split(", ")]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        t = Trigger(unit, n, timeouts, until)
        if state.exists:
            t.load(state.get)
        out = []
        for r in pd.concat(list(parts)).sort_values(["us", "pkt_id"]).itertuples(index=False):
            if t.packet(int(r.us), int(r.size or 0), key[2] == 17):
                out.append((*key, t.conn_no, r.pkt_id, r.us, t.pkts, t.bytes, t.firings))
        state.update(t.state())
        idle = timeouts.udp if key[2] == 17 else timeouts.tcp
        state.setTimeoutTimestamp(max((t.last_us + idle) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=names)

    grouped = rows.groupBy(*KEY)
    return grouped.applyInPandasWithState(step, OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
