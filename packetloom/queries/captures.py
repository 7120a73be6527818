"""Queries on frames: decoding, triggers that follow the order of packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.headers import decode
from packetloom.operators.conntrack import Timeouts
from packetloom.queries import flows
from packetloom.sources.adapters import packets_from_events
from packetloom.sources.tables import table
from packetloom.streaming.triggers import batch_triggers

LONG = Timeouts(establish=120_000_000)


def _frames_of_packets(spark: SparkSession, d: str) -> DataFrame:
    """Frames whose header bytes are written from the columns of IPv4 packets."""
    p = table(spark, d, "packets").select("pkt_id", "proto", "src_addr", "dst_addr", "src_port", "dst_port", "seq_no", "ack_no", "tcp_flags", "time_to_live", "total_length").distinct()
    p = p.where("src_addr is not null and dst_addr is not null and src_port is not null and dst_port is not null and total_length between 0 and 65535 and time_to_live is not null")
    h = lambda c, n: F.lpad(F.hex(F.coalesce(F.col(c), F.lit(0)).cast("bigint")), 2 * n, "0")
    ip = F.concat(F.lit("02000000000102000000000a08004500"), h("total_length", 2), F.lit("00000000"), h("time_to_live", 1), h("proto", 1), F.lit("0000"), h("src_addr", 4), h("dst_addr", 4), h("src_port", 2), h("dst_port", 2))
    tail = F.when(F.col("proto") == 6, F.concat(h("seq_no", 4), h("ack_no", 4), F.lit("50"), h("tcp_flags", 1), F.lit("000000000000"))).otherwise(F.lit("00080000"))
    return p.select("pkt_id", F.unhex(F.concat(ip, tail)).alias("frame"))


def ct_decode(spark: SparkSession, d: str) -> DataFrame:
    """Header fields read back from frames; packets whose lengths contradict each other have none."""
    x = decode(_frames_of_packets(spark, d), names=["ipv4_ihl", "tcp_data_offset"])
    return x.select("pkt_id", *[F.coalesce(F.col(c).cast("bigint"), F.lit(-1)).alias(c) for c in ("proto", "src_addr", "dst_addr", "src_port", "dst_port", "seq_no", "ack_no", "tcp_flags", "time_to_live", "payload_len", "ipv4_ihl", "tcp_data_offset")])


def ex_streaming(spark: SparkSession, d: str) -> DataFrame:
    """Packet and byte counts of connections at every tenth packet to or from one port."""
    from packetloom.plans.subscribe import Subscription
    from packetloom.streaming.triggers import deliver_firings

    sub = Subscription("tcp.port = 443", ("PktCount", "FilterStr"), streaming=("packets", 10))
    return deliver_firings(sub, packets_from_events(spark, d), LONG).select("pkt_id", "PktCount", "FilterStr", "byte_count")


def _fired(unit: str, n: float, until=None):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return batch_triggers(packets_from_events(spark, d), unit, n, LONG, until).select("pkt_id", "pkt_count", "byte_count", "firing")

    return run


QUERIES = {
    **{f.__name__: f for f in (ct_decode, ex_streaming)},
    "str_bytes_n": _fired("bytes", 1000), "str_seconds_s": _fired("seconds", 60), "str_packets_state": _fired("packets", 3), "str_unsubscribe": _fired("packets", 2, lambda pkts, size: pkts >= 5),
}
#: Triggers by bytes and seconds depend on what fired before, so SQL walks each connection packet by packet.
_WALK = """, n as (select hi, lo, proto, conn_no, pkt_id, us, frame_len, nth, sum(frame_len) over (partition by hi, lo, proto, conn_no order by us, pkt_id) bytes from r),
w as (select hi, lo, proto, conn_no, pkt_id, nth, bytes, true fires, {first} state, 1 firing from n where nth = 1
  union all select n.hi, n.lo, n.proto, n.conn_no, n.pkt_id, n.nth, n.bytes, {test}, case when {test} then {again} else {keep} end, w.firing + case when {test} then 1 else 0 end
  from w join n on n.hi = w.hi and n.lo = w.lo and n.proto = w.proto and n.conn_no = w.conn_no and n.nth = w.nth + 1)
select pkt_id, nth::bigint pkt_count, bytes::bigint byte_count, firing::int firing from w where fires"""
_recursive = lambda walk: flows._XE.replace("with", "with recursive", 1) + walk

SQL = {
    "str_bytes_n": _recursive(_WALK.format(first="1000::bigint", test="w.state - n.frame_len <= 0", again="1000", keep="w.state - n.frame_len")),
    "str_seconds_s": _recursive(_WALK.format(first="us", test="n.us - w.state >= 60000000", again="n.us", keep="w.state")),
    "ex_streaming": f"{flows._XE}, f as (select *, row_number() over (partition by hi, lo, proto, conn_no order by us, pkt_id) k, sum(frame_len) over (partition by hi, lo, proto, conn_no order by us, pkt_id) bytes from r where proto = 6 and (sport = 443 or dport = 443)) select pkt_id, k::bigint as \"PktCount\", 'tcp.port = 443' as \"FilterStr\", bytes::bigint byte_count from f where (k - 1) % 10 = 0",
    "str_packets_state": f"{flows._XE} select pkt_id, nth::bigint pkt_count, byte_count::bigint byte_count, ((nth - 1) // 3 + 1)::int firing from (select *, sum(frame_len) over (partition by hi, lo, proto, conn_no order by us, pkt_id) byte_count from r) where (nth - 1) % 3 = 0",
    "str_unsubscribe": f"{flows._XE} select pkt_id, nth::bigint pkt_count, byte_count::bigint byte_count, ((nth - 1) // 2 + 1)::int firing from (select *, sum(frame_len) over (partition by hi, lo, proto, conn_no order by us, pkt_id) byte_count from r) where (nth - 1) % 2 = 0 and nth <= 5",
    "ct_decode": """with pk as (select distinct pkt_id, proto, src_addr, dst_addr, src_port, dst_port, seq_no, ack_no, tcp_flags, time_to_live, total_length from packets
  where src_addr is not null and dst_addr is not null and src_port is not null and dst_port is not null and total_length between 0 and 65535 and time_to_live is not null),
x as (select *, total_length - 20 - case when proto = 6 then 20 else 8 end size from pk)
select pkt_id, (case when size >= 0 then proto else -1 end)::bigint proto, src_addr, dst_addr, (case when size >= 0 then src_port else -1 end)::bigint src_port, (case when size >= 0 then dst_port else -1 end)::bigint dst_port,
  (case when size < 0 then -1 when proto = 6 then coalesce(seq_no, 0) else 0 end)::bigint seq_no, (case when size < 0 then -1 when proto = 6 then coalesce(ack_no, 0) else 0 end)::bigint ack_no,
  (case when size < 0 then -1 when proto = 6 then coalesce(tcp_flags, 0) else 0 end)::bigint tcp_flags, time_to_live::bigint time_to_live, (case when size >= 0 then size else -1 end)::bigint payload_len, 5::bigint ipv4_ihl,
  (case when size >= 0 and proto = 6 then 5 else -1 end)::bigint tcp_data_offset from x""",
}
