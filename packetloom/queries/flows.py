"""Queries on connections made from packets: key, orientation, expiry, features, triggers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.operators import conntrack as C
from packetloom.sources.adapters import FLOWS_SQL, PACKETS_SQL, flows_from_packets

LONG = C.Timeouts(establish=120_000_000)
OFFLINE = C.Timeouts(offline=True)
_ID = ["orig", "orig_port", "resp", "resp_port", "proto", "first_us"]


def _conns(spark: SparkSession, d: str, timeouts: C.Timeouts = LONG) -> DataFrame:
    return C.connections(flows_from_packets(spark, d), timeouts).withColumns({"orig": F.hex("orig_ip"), "resp": F.hex("resp_ip")})


def ct_conn_key(spark: SparkSession, d: str) -> DataFrame:
    """Packets and bytes of both directions under one key."""
    p = C.with_key(flows_from_packets(spark, d))
    return p.groupBy(F.hex("key_hi").alias("hi"), F.hex("key_lo").alias("lo"), "proto").agg(F.count(F.lit(1)).alias("n"), F.sum("frame_len").alias("bytes"), F.sum(F.when(F.col("from_hi"), 1).otherwise(0)).alias("n_from_hi"))


def ct_orientation(spark: SparkSession, d: str) -> DataFrame:
    return _conns(spark, d, OFFLINE).select("orig", "orig_port", "resp", "resp_port", "proto", "first_us")


def ct_offline(spark: SparkSession, d: str) -> DataFrame:
    return _conns(spark, d, OFFLINE).select(*_ID, "last_us", "pkt_count", "byte_count")


def ct_timeout_udp(spark: SparkSession, d: str) -> DataFrame:
    return _conns(spark, d).where("proto = 17").select(*_ID, "last_us", "pkt_count")


def ct_timeout_tcp(spark: SparkSession, d: str) -> DataFrame:
    return _conns(spark, d).where("proto = 6").select(*_ID, "last_us", "pkt_count")


def agg_pktcount(spark: SparkSession, d: str) -> DataFrame:
    return _conns(spark, d).select(*_ID, "pkt_count")


def agg_bytecount(spark: SparkSession, d: str) -> DataFrame:
    return _conns(spark, d).select(*_ID, "byte_count")


def agg_duration(spark: SparkSession, d: str) -> DataFrame:
    return _conns(spark, d).select(*_ID, F.expr("duration_us div 1000").alias("duration_ms"))


def agg_maxinactivity(spark: SparkSession, d: str) -> DataFrame:
    return _conns(spark, d).select(*_ID, "to_second_us", "max_idle_us")


def agg_history(spark: SparkSession, d: str) -> DataFrame:
    return _conns(spark, d).select(*_ID, "history")


def agg_flow(spark: SparkSession, d: str) -> DataFrame:
    return _conns(spark, d).select(*_ID, "orig_n_pkts", "orig_n_malformed", "orig_n_bytes", "orig_n_payload", "resp_n_pkts", "resp_n_malformed", "resp_n_bytes", "resp_n_payload")


def agg_connrecord(spark: SparkSession, d: str) -> DataFrame:
    cols = ["last_us", "duration_us", "to_second_us", "max_idle_us", "history", "pkt_count", "byte_count", "orig_n_pkts", "orig_n_malformed", "orig_n_bytes", "orig_n_payload", "resp_n_pkts", "resp_n_malformed", "resp_n_bytes", "resp_n_payload"]
    return _conns(spark, d).select(*_ID, *cols)


def _assigned(spark: SparkSession, d: str, numbers: bool = False) -> DataFrame:
    return C.assign(flows_from_packets(spark, d), LONG, numbers=numbers)


_CONN = ["hi", "lo", "proto", "conn_no"]


def _named(df: DataFrame) -> DataFrame:
    return df.withColumns({"hi": F.hex("key_hi"), "lo": F.hex("key_lo"), "conn_no": F.col("conn_no").cast("bigint")})


def agg_interarrivals(spark: SparkSession, d: str) -> DataFrame:
    """The gaps of each direction, in order."""
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return _named(C.interarrivals(_assigned(spark, d, numbers=True))).select(*_CONN, text("interarrivals_ctos"), text("interarrivals_stoc"))


def agg_gap_figures(spark: SparkSession, d: str) -> DataFrame:
    """Number, sum and largest of the gaps of each direction, without their lists."""
    return _named(C.gap_figures(_assigned(spark, d, numbers=True))).drop("key_hi", "key_lo")


def agg_pktlists(spark: SparkSession, d: str) -> DataFrame:
    """Ids of each connection's packets in order of arrival, of both directions and of each."""
    x = C.packet_lists(_assigned(spark, d))
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return _named(x).select(*_CONN, text("packets"), text("packets_orig"), text("packets_resp"))


def agg_content_gaps(spark: SparkSession, d: str) -> DataFrame:
    c = C.content(_assigned(spark, d))
    return _named(c).select("hi", "lo", "conn_no", F.col("dir").alias("from_orig"), *[F.col(x).cast("bigint").alias(x) for x in ("n_chunks", "content_gaps", "missed_bytes")])


def jn_conn_packets(spark: SparkSession, d: str) -> DataFrame:
    """All packets of the connections in which any packet resets."""
    p = C.assign(flows_from_packets(spark, d), LONG, marks={"reset": F.col("tcp_flags").bitwiseAND(C.RST) != 0})
    return p.where("reset").select("pkt_id", "proto", "frame_len")


def str_packets_n(spark: SparkSession, d: str) -> DataFrame:
    """Firings of a trigger at the first packet of a connection and at every third after it."""
    p = _assigned(spark, d, numbers=True)
    return p.where(F.pmod(F.col("nth") - 1, F.lit(3)) == 0).select("pkt_id", F.col("nth").cast("bigint").alias("pkt_count"), F.col("bytes_so_far").alias("byte_count"))


QUERIES = {f.__name__: f for f in (ct_conn_key, ct_orientation, ct_offline, ct_timeout_udp, ct_timeout_tcp, agg_pktcount, agg_bytecount, agg_duration, agg_maxinactivity, agg_history, agg_flow, agg_connrecord, agg_pktlists, agg_interarrivals, agg_gap_figures, agg_content_gaps, jn_conn_packets, str_packets_n)}

_EVENTS = PACKETS_SQL.rstrip() + """,
k as (select *, printf('%08X%04X', src, sport) se, printf('%08X%04X', dst, dport) de from pk)"""
_FLOWS = FLOWS_SQL.rstrip() + """,
k as (select * from pk)"""
_KK = """,
kk as (select *, greatest(se, de) hi, least(se, de) lo, se >= de from_hi from k)
"""
_KEYED = _FLOWS + _KK


def _split(idle: str, source: str = _FLOWS) -> str:
    return source + _KK + f""",
g as (select *, us - lag(us) over (partition by hi, lo, proto order by us, pkt_id) gap0 from kk),
s as (select *, sum(case when gap0 > {idle} then 1 else 0 end) over (partition by hi, lo, proto order by us, pkt_id) conn_no from g),
o as (select *, first(from_hi) over (partition by hi, lo, proto, conn_no order by us, pkt_id) orig_hi, row_number() over (partition by hi, lo, proto, conn_no order by us, pkt_id) nth,
  case when row_number() over (partition by hi, lo, proto, conn_no order by us, pkt_id) > 1 then gap0 end gap from s),
r as (select *, from_hi = orig_hi as own, payload_len is null or payload_len < 0 or payload_len > frame_len bad from o),
m as (select hi, lo, proto, conn_no, own, letter, min(us) us, min(us::hugeint * 100000000000 + pkt_id * 10 + rank) place from (
    select hi, lo, proto, conn_no, own, us, pkt_id, unnest([case when proto = 6 and flags = 2 then 'S' end, case when proto = 6 and flags = 18 then 'H' end, case when proto = 6 and flags = 16 and coalesce(payload_len, 0) = 0 then 'A' end,
      case when proto = 6 and (flags & 1) <> 0 then 'F' end, case when proto = 6 and (flags & 4) <> 0 then 'R' end, case when payload_len > 0 then 'D' end]) letter, unnest([0, 1, 2, 3, 4, 5]) rank from r)
  where letter is not null group by all),
h as (select hi, lo, proto, conn_no, string_agg(case when own then letter else lower(letter) end, '' order by place, letter) history from m group by all),
c as (select hi, lo, proto, conn_no, any_value(case when orig_hi then hi else lo end) o_, any_value(case when orig_hi then lo else hi end) r_,
  min(us) first_us, max(us) last_us, min(us) filter (nth = 2) second_us, coalesce(max(gap), 0) max_idle_us, count(*) pkt_count, sum(frame_len) byte_count,
  count(*) filter (own) orig_n_pkts, coalesce(sum(frame_len) filter (own), 0) orig_n_bytes, coalesce(sum(payload_len) filter (own and not bad), 0) orig_n_payload, count(*) filter (own and bad) orig_n_malformed,
  count(*) filter (not own) resp_n_pkts, coalesce(sum(frame_len) filter (not own), 0) resp_n_bytes, coalesce(sum(payload_len) filter (not own and not bad), 0) resp_n_payload, count(*) filter (not own and bad) resp_n_malformed from r group by all),
x as (select c.*, coalesce(history, '') history, substr(o_, 1, length(o_) - 4) orig, ('0x' || right(o_, 4))::int orig_port, substr(r_, 1, length(r_) - 4) resp, ('0x' || right(r_, 4))::int resp_port, last_us - first_us duration_us, coalesce(second_us - first_us, 0) to_second_us from c left join h using (hi, lo, proto, conn_no))
"""


_IDLE = "case when proto = 17 then 60000000 else 300000000 end"
_X = _split(_IDLE)
_XE = _split(_IDLE, _EVENTS)
_OFF = _split("9223372036854775807")
_SQL_ID = "orig, orig_port, resp, resp_port, proto, first_us"
_big = lambda *cols: ", ".join(f"{c}::bigint {c}" for c in cols)
_ALL = ("last_us", "duration_us", "to_second_us", "max_idle_us", "pkt_count", "byte_count", "orig_n_pkts", "orig_n_malformed", "orig_n_bytes", "orig_n_payload", "resp_n_pkts", "resp_n_malformed", "resp_n_bytes", "resp_n_payload")
SQL = {
    "ct_conn_key": f"{_KEYED} select hi, lo, proto, count(*)::bigint n, sum(frame_len)::bigint bytes, count(*) filter (from_hi)::bigint n_from_hi from kk group by all",
    "ct_orientation": f"{_OFF} select {_SQL_ID} from x",
    "ct_offline": f"{_OFF} select {_SQL_ID}, {_big('last_us', 'pkt_count', 'byte_count')} from x",
    "ct_timeout_udp": f"{_X} select {_SQL_ID}, {_big('last_us', 'pkt_count')} from x where proto = 17",
    "ct_timeout_tcp": f"{_X} select {_SQL_ID}, {_big('last_us', 'pkt_count')} from x where proto = 6",
    "agg_pktcount": f"{_X} select {_SQL_ID}, {_big('pkt_count')} from x",
    "agg_bytecount": f"{_X} select {_SQL_ID}, {_big('byte_count')} from x",
    "agg_duration": f"{_X} select {_SQL_ID}, (duration_us // 1000)::bigint duration_ms from x",
    "agg_maxinactivity": f"{_X} select {_SQL_ID}, {_big('to_second_us', 'max_idle_us')} from x",
    "agg_history": f"{_X} select {_SQL_ID}, history from x",
    "agg_flow": f"{_X} select {_SQL_ID}, {_big('orig_n_pkts', 'orig_n_malformed', 'orig_n_bytes', 'orig_n_payload', 'resp_n_pkts', 'resp_n_malformed', 'resp_n_bytes', 'resp_n_payload')} from x",
    "agg_connrecord": f"{_X} select {_SQL_ID}, history, {_big(*_ALL)} from x",
    "agg_interarrivals": f"""{_X}, i as (select *, (us - lag(us) over (partition by hi, lo, proto, conn_no, own order by us, pkt_id)) * 1000 d from r)
select hi, lo, proto, conn_no::bigint conn_no, coalesce(string_agg(d::varchar, ',' order by us, pkt_id) filter (own and d is not null), '') interarrivals_ctos, coalesce(string_agg(d::varchar, ',' order by us, pkt_id) filter (not own and d is not null), '') interarrivals_stoc
from i group by i.hi, i.lo, proto, i.conn_no""",
    "agg_gap_figures": f"""{_X}, i as (select *, (us - lag(us) over (partition by hi, lo, proto, conn_no, own order by us, pkt_id)) * 1000 d from r)
select hi, lo, proto, conn_no::bigint conn_no, count(d) filter (own)::bigint n_ctos, coalesce(sum(d) filter (own), 0)::bigint sum_ctos, coalesce(max(d) filter (own), 0)::bigint max_ctos,
  count(d) filter (not own)::bigint n_stoc, coalesce(sum(d) filter (not own), 0)::bigint sum_stoc, coalesce(max(d) filter (not own), 0)::bigint max_stoc from i group by i.hi, i.lo, proto, i.conn_no""",
    "agg_pktlists": f"""{_X} select hi, lo, proto, conn_no::bigint conn_no, string_agg(pkt_id::varchar, ',' order by us, pkt_id) packets, coalesce(string_agg(pkt_id::varchar, ',' order by us, pkt_id) filter (own), '') packets_orig,
  coalesce(string_agg(pkt_id::varchar, ',' order by us, pkt_id) filter (not own), '') packets_resp from r group by r.hi, r.lo, proto, r.conn_no""",
    "agg_content_gaps": f"""{_X}, base as (select hi, lo, conn_no, own, arg_min(seq_no, us::hugeint * 100000000000 + pkt_id) base from r where proto = 6 and payload_len > 0 and seq_no is not null group by all),
y as (select distinct r.hi, r.lo, conn_no, own, (seq_no - base + 6442450944) % 4294967296 - 2147483648 a, (seq_no - base + 6442450944) % 4294967296 - 2147483648 + payload_len b from r join base using (hi, lo, conn_no, own) where proto = 6 and payload_len > 0 and seq_no is not null),
z as (select *, max(b) over (partition by hi, lo, conn_no, own order by a, b rows between unbounded preceding and 1 preceding) before from y)
select hi, lo, conn_no::bigint conn_no, own from_orig, count(*) filter (before is null or a > before)::bigint n_chunks, (count(*) filter (before is null or a > before) - 1)::bigint content_gaps,
  coalesce(sum(a - before) filter (a > before), 0)::bigint missed_bytes from z group by z.hi, z.lo, z.conn_no, own""",
    "jn_conn_packets": f"{_X}, hit as (select distinct hi, lo, proto, conn_no from r where (flags & 4) <> 0) select pkt_id, proto, frame_len from r semi join hit using (hi, lo, proto, conn_no)",
    "str_packets_n": f"{_X} select pkt_id, nth::bigint pkt_count, byte_count::bigint byte_count from (select *, sum(frame_len) over (partition by hi, lo, proto, conn_no order by us, pkt_id) byte_count from r) where (nth - 1) % 3 = 0",
}
