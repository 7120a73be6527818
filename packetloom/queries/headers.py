"""Queries on single packets: comparison operators, filter rules, sampling, prefixes, counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.filterlang import Filter, holds
from packetloom.functions.net import ipv4_subnet, transport_name, wire_bits, wrapping_lt
from packetloom.plans.subscribe import continue_packets
from packetloom.operators.rules import Rule, match_filters, match_prefixes
from packetloom.sources.config import sample_flows
from packetloom.queries.services import _C
from packetloom.sources.tables import table
from packetloom.sources.traffic import connection_rows

Query = Callable[[SparkSession, str], DataFrame]

_HEADERS = ["pkt_id", "ip_version", "proto", "src_ip", "dst_ip", "src_addr", "dst_addr", "src_port", "dst_port", "time_to_live", "total_length", "tcp_flags", "seq_no", "ack_no", "frame_len", "payload_len"]
_PK = "with pk as (select distinct pkt_id, ip_version, proto, src_ip, dst_ip, src_addr, dst_addr, src_port, dst_port, time_to_live, total_length, tcp_flags, seq_no, ack_no, frame_len, payload_len from packets)"


def _packets(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Packets, each once, with the columns named."""
    return table(spark, d, "packets").select("pkt_id", *columns).distinct()


def _filtered(text: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        p = table(spark, d, "packets")
        kept = p.where(Filter(text).on_packets(p.columns, exact=True))  # before copies are dropped, so it reaches the scan
        return kept.select("pkt_id", "proto", "frame_len").distinct()

    return run


#: name: filter, SQL condition.
FILTERS = {
    "op_eq": ("tcp.dst_port = 443", "proto = 6 and dst_port = 443"),
    "op_ne": ("udp.dst_port != 53", "proto = 17 and dst_port != 53"),
    "op_ge": ("ipv4.time_to_live >= 128", "ip_version = 4 and time_to_live >= 128"),
    "op_le": ("ipv4.total_length le 60", "ip_version = 4 and total_length <= 60"),
    "op_gt": ("tcp.src_port > 60000", "proto = 6 and src_port > 60000"),
    "op_lt": ("ipv4.time_to_live lt 60", "ip_version = 4 and time_to_live < 60"),
    "op_in_range": ("tcp.port in 8000..8999", "proto = 6 and (coalesce(src_port between 8000 and 8999, false) or coalesce(dst_port between 8000 and 8999, false))"),
    "op_in_cidr4": ("ipv4.dst_addr in 198.18.0.0/16", "ip_version = 4 and dst_addr between 3323068416 and 3323133951"),
    "op_eq_cidr4": ("ipv4.src_addr = 10.0.0.0/9", "ip_version = 4 and src_addr between 167772160 and 176160767"),
    "op_ne_cidr4": ("ipv4.dst_addr != 172.16.0.0/12", "ip_version = 4 and dst_addr not between 2886729728 and 2887778303"),
    "op_in_cidr6": ("ipv6.addr in 2001:db8::/33", "ip_version = 6 and (hex(src_ip) between '20010DB8000000000000000000000000' and '20010DB87FFFFFFFFFFFFFFFFFFFFFFF' or hex(dst_ip) between '20010DB8000000000000000000000000' and '20010DB87FFFFFFFFFFFFFFFFFFFFFFF')"),
    "flt_combined_or": ("udp.port = 53", "proto = 17 and (coalesce(src_port = 53, false) or coalesce(dst_port = 53, false))"),
    "flt_combined_ne_and": ("tcp.port != 443", "proto = 6 and src_port != 443 and dst_port != 443"),
    "flt_precedence": ("tcp.dst_port = 22 or udp and ipv4.time_to_live < 64", "(proto = 6 and dst_port = 22) or (proto = 17 and ip_version = 4 and time_to_live < 64)"),
    "flt_parens": ("(tcp.dst_port = 22 or tcp.dst_port = 80) and ipv4.time_to_live > 63", "proto = 6 and dst_port in (22, 80) and ip_version = 4 and time_to_live > 63"),
    "flt_empty": ("", "true"),
    "flt_fq_expand": ("tcp", "proto = 6 and ip_version in (4, 6)"),
    "flt_flags": ("tcp.syn = 1 and tcp.ack = 0", "proto = 6 and (tcp_flags & 2) <> 0 and (tcp_flags & 16) = 0"),
    "flt_synack": ("tcp.synack = 1", "proto = 6 and (tcp_flags & 18) <> 0"),
    "stg_packet_continue": ("(ipv4 and tcp.dst_port in 1..1023) or ipv6 and udp", "(ip_version = 4 and proto = 6 and dst_port between 1 and 1023) or (ip_version = 6 and proto = 17)"),
}


def src_sampling(spark: SparkSession, d: str) -> DataFrame:
    """Half of the flows, whole: 256 of 512 buckets of a key that is the same in both directions."""
    kept = sample_flows(_packets(spark, d, "src_ip", "dst_ip", "src_port", "dst_port", "proto", "frame_len"), 256)
    return kept.select("pkt_id", "proto", "frame_len")


NETS = [("lab", "198.18.0.0", 15), ("lab_low", "198.18.0.0", 17), ("inside", "10.0.0.0", 8), ("servers", "172.16.0.0", 12), ("host", "198.18.0.37", 32), ("all", "0.0.0.0", 0)]


def _number(text: str) -> int:
    a, b, c, e = map(int, text.split("."))
    return a << 24 | b << 16 | c << 8 | e


def jn_cidr_range(spark: SparkSession, d: str) -> DataFrame:
    """Packets by each prefix that holds their destination."""
    nets = spark.createDataFrame([(n, _number(a), p) for n, a, p in NETS], "rule string, low bigint, prefix int")
    met = match_prefixes(_packets(spark, d, "dst_addr", "frame_len"), nets, "dst_addr")
    return met.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum("frame_len").alias("bytes"))


#: Packet rules of an intrusion signature set's kind: name, filter, SQL condition.
RULES = [
    ("ttl_one", "udp and ipv4.time_to_live = 1", "proto = 17 and ip_version = 4 and time_to_live = 1"),
    ("ttl_high_syn", "tcp.syn = 1 and tcp.ack = 0 and ipv4.time_to_live > 100", "proto = 6 and (tcp_flags & 2) <> 0 and (tcp_flags & 16) = 0 and ip_version = 4 and time_to_live > 100"),
    ("mail_ack", "tcp.dst_port = 25 and tcp.ack = 1", "proto = 6 and dst_port = 25 and (tcp_flags & 16) <> 0"),
    ("to_lab_web", "ipv4.dst_addr in 198.18.0.0/15 and (tcp.dst_port = 80 or tcp.dst_port = 443)", "ip_version = 4 and dst_addr between 3323068416 and 3323199487 and proto = 6 and dst_port in (80, 443)"),
    ("low_ports", "udp.dst_port in 1..1023", "proto = 17 and dst_port between 1 and 1023"),
    ("reset", "tcp.rst = 1", "proto = 6 and (tcp_flags & 4) <> 0"),
]


def jn_rules_packets(spark: SparkSession, d: str) -> DataFrame:
    p = _packets(spark, d, *[c for c in _HEADERS if c != "pkt_id"])
    met = match_filters(p, [Rule(n, f) for n, f, _ in RULES])
    return met.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dst_addr").alias("n_targets"))


#: As many rules as a large deployment has: number of each kind, filter and SQL condition of rule i.
MANY = [
    (1299, "tcp.dst_port = {i} and ipv4.time_to_live >= {ttl}", "ip_version = 4 and proto = 6 and dst_port = i and time_to_live >= i % 60 + 30"),
    (244, "udp.port = {three} or tcp.src_port = {high}", "(proto = 17 and (coalesce(src_port = i * 3, false) or coalesce(dst_port = i * 3, false))) or (proto = 6 and src_port = 40000 + i)"),
    (16, "ipv4.dst_addr in 198.18.{eight}.0/21 and udp", "ip_version = 4 and proto = 17 and dst_addr between 3323068416 + i * 2048 and 3323068416 + i * 2048 + 2047"),
    (16, "ipv4.time_to_live = {nine} and tcp.syn = 1", "ip_version = 4 and proto = 6 and time_to_live = i * 9 and (tcp_flags & 2) <> 0"),
]


def many_rules(most: int = 1575) -> list[Rule]:
    every = [Rule(f"k{k}_{i}", f.format(i=i, ttl=i % 60 + 30, three=i * 3, high=40000 + i, eight=i * 8, nine=i * 9)) for k, (n, f, _) in enumerate(MANY) for i in range(n)]
    return every[:: max(1, len(every) // most)][:most]


def jn_rules_many(spark: SparkSession, d: str) -> DataFrame:
    """Packets and bytes of each of 1,575 rules, all decided in one pass."""
    p = _packets(spark, d, "ip_version", "proto", "src_addr", "dst_addr", "src_port", "dst_port", "time_to_live", "tcp_flags", "frame_len")
    return match_filters(p, many_rules()).groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.sum("frame_len").alias("bytes"))


def stg_packet_shared(spark: SparkSession, d: str) -> DataFrame:
    """Packets that any of several subscriptions may want, also those decided later."""
    p = _packets(spark, d, *[c for c in _HEADERS if c != "pkt_id"])
    return continue_packets(p, [Filter(t) for t in ("udp.dst_port = 53", "tls.sni ~ 'x' and tcp.dst_port = 443", "ipv4.time_to_live < 10")]).select("pkt_id", "proto")


def fn_subnet(spark: SparkSession, d: str) -> DataFrame:
    p = _packets(spark, d, "dst_addr", "frame_len").where(F.col("dst_addr").isNotNull())
    return p.groupBy(ipv4_subnet(F.col("dst_addr")).alias("subnet")).agg(F.count(F.lit(1)).alias("n"))


def fn_wrapping_lt(spark: SparkSession, d: str) -> DataFrame:
    p = _packets(spark, d, "seq_no", "ack_no", "proto").where(F.col("proto") == 6)
    return p.select("pkt_id", wrapping_lt(F.col("seq_no"), F.col("ack_no")).alias("before"))


def fn_wire_bits(spark: SparkSession, d: str) -> DataFrame:
    p = _packets(spark, d, "proto", "frame_len")
    g = p.groupBy("proto").agg(F.sum("frame_len").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return g.select("proto", wire_bits(F.col("bytes"), F.col("n")).alias("ingress_bits"), wire_bits(F.col("bytes"), F.col("n"), True).alias("good_bits"))


def obs_counters(spark: SparkSession, d: str) -> DataFrame:
    """Counts of packets and bytes, in all and by transport, and of those a filter ignores."""
    p = _packets(spark, d, *[c for c in _HEADERS if c != "pkt_id"])
    kept = holds(Filter("tcp or udp.port = 53").on_packets(p.columns, exact=True))
    size = F.col("frame_len").cast("bigint")
    one = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("bigint")
    tcp, udp, any_ = F.col("proto") == 6, F.col("proto") == 17, F.lit(True)
    return p.agg(
        one(any_, 1).alias("total_pkts"), one(any_, size).alias("total_bytes"), one(tcp, 1).alias("tcp_pkts"), one(tcp, size).alias("tcp_bytes"), one(udp, 1).alias("udp_pkts"), one(udp, size).alias("udp_bytes"),
        one(~kept, 1).alias("ignored_pkts"), one(~kept, size).alias("ignored_bytes"),
    )


def ex_port_count(spark: SparkSession, d: str) -> DataFrame:
    """Packets and connections by transport, port and side, and connections and their packets by application protocol."""
    packets = _packets(spark, d, "proto", "src_port", "dst_port").select(F.lit("packets").alias("kind"), transport_name(F.col("proto")).alias("name"), F.lit(1).cast("bigint").alias("n"), "src_port", "dst_port")
    c = connection_rows(spark, d)
    ends = [F.col("orig_port").alias("src_port"), F.col("resp_port").alias("dst_port")]
    one = F.lit(1).cast("bigint").alias("n")
    conns = c.select(F.lit("connections").alias("kind"), transport_name(F.col("proto")).alias("name"), one, *ends)
    parsed = c.where(F.col("service").isNotNull()).select(F.explode(F.array(F.struct(F.lit("parsed connections").alias("kind"), one), F.struct(F.lit("parsed packets").alias("kind"), F.coalesce("pkt_count", F.lit(0)).alias("n")))).alias("x"), F.col("service").alias("name"), *ends).select("x.kind", "name", "x.n", "src_port", "dst_port")
    sides = F.array(F.struct(F.col("src_port").alias("port"), F.col("n").alias("orig"), F.lit(0).cast("bigint").alias("resp")), F.struct(F.col("dst_port").alias("port"), F.lit(0).cast("bigint").alias("orig"), F.col("n").alias("resp")))
    e = packets.unionByName(conns).unionByName(parsed).select("kind", "name", F.explode(sides).alias("x")).select("kind", "name", "x.*").where(F.col("port").isNotNull())
    return e.groupBy("kind", "name", "port").agg(F.sum("orig").alias("n_orig"), F.sum("resp").alias("n_resp"))


_CASES = " union all ".join(f"select '{n}' as rule, dst_addr from pk where {c}" for n, _, c in RULES)
_NET_SQL = " union all ".join(f"select '{n}' as rule, {_number(a)} as low, {_number(a) | (1 << (32 - p)) - 1} as high" for n, a, p in NETS)
_KEPT = "(proto = 6 and ip_version in (4, 6)) or (proto = 17 and (coalesce(src_port = 53, false) or coalesce(dst_port = 53, false)))"

QUERIES: dict[str, Query] = {
    **{n: _filtered(f) for n, (f, _) in FILTERS.items()},
    "src_sampling": src_sampling, "jn_cidr_range": jn_cidr_range, "jn_rules_packets": jn_rules_packets, "jn_rules_many": jn_rules_many, "stg_packet_shared": stg_packet_shared, "fn_subnet": fn_subnet, "fn_wrapping_lt": fn_wrapping_lt, "fn_wire_bits": fn_wire_bits,
    "obs_counters": obs_counters, "ex_port_count": ex_port_count,
}
SQL = {
    **{n: f"{_PK} select pkt_id, proto, frame_len from pk where {c}" for n, (_, c) in FILTERS.items()},
    "src_sampling": f"""{_PK}, k as (select *, hex(src_ip) || printf('%04X', src_port) s, hex(dst_ip) || printf('%04X', dst_port) e from pk where src_port is not null and dst_port is not null and src_ip is not null and dst_ip is not null and proto in (6, 17))
select pkt_id, proto, frame_len from k where ('0x' || substr(md5(greatest(s, e) || least(s, e) || proto), 1, 4))::int % 512 < 256""",
    "jn_cidr_range": f"{_PK}, nets as ({_NET_SQL}) select rule, count(*)::bigint n, sum(frame_len)::bigint bytes from pk join nets on dst_addr between low and high group by rule",
    "jn_rules_packets": f"{_PK} select rule, count(*)::bigint n, count(distinct dst_addr)::bigint n_targets from ({_CASES}) group by rule",
    "jn_rules_many": f"{_PK} select rule, count(*)::bigint n, sum(frame_len)::bigint bytes from (" + " union all ".join(f"select 'k{k}_' || i as rule, frame_len from pk join (select unnest(range(0, {n})) i) r on {c}" for k, (n, _, c) in enumerate(MANY)) + ") group by rule",
    "stg_packet_shared": f"{_PK} select pkt_id, proto from pk where (proto = 17 and dst_port = 53) or (proto = 6 and dst_port = 443) or (ip_version = 4 and time_to_live < 10)",
    "fn_subnet": f"{_PK} select case when dst_addr = 4294967295 or dst_addr >> 28 = 14 then concat_ws('.', dst_addr >> 24, (dst_addr >> 16) & 255, (dst_addr >> 8) & 255, dst_addr & 255) else concat_ws('.', dst_addr >> 24, (dst_addr >> 16) & 255, (dst_addr >> 8) & 255, 0) end subnet, count(*)::bigint n from pk where dst_addr is not null group by 1",
    "fn_wrapping_lt": f"{_PK} select pkt_id, ((seq_no - ack_no) % 4294967296 + 4294967296) % 4294967296 > 2147483648 as before from pk where proto = 6",
    "fn_wire_bits": f"{_PK} select proto, ((sum(frame_len) + count(*) * 20) * 8)::bigint ingress_bits, ((sum(frame_len) + count(*) * 24) * 8)::bigint good_bits from pk group by proto",
    "obs_counters": f"{_PK} select count(*)::bigint total_pkts, sum(frame_len)::bigint total_bytes, count(*) filter (proto = 6)::bigint tcp_pkts, coalesce(sum(frame_len) filter (proto = 6), 0)::bigint tcp_bytes, count(*) filter (proto = 17)::bigint udp_pkts, coalesce(sum(frame_len) filter (proto = 17), 0)::bigint udp_bytes, count(*) filter (not ({_KEPT}))::bigint ignored_pkts, coalesce(sum(frame_len) filter (not ({_KEPT})), 0)::bigint ignored_bytes from pk",
    "ex_port_count": f"""{_C}, pk as (select distinct pkt_id, proto, src_port, dst_port from packets),
x as (select 'packets' kind, case proto when 6 then 'tcp' when 17 then 'udp' else 'none' end as name, 1 n, src_port s, dst_port e from pk union all select 'connections', case proto when 6 then 'tcp' when 17 then 'udp' else 'none' end, 1, orig_port, resp_port from c
  union all select 'parsed connections', service, 1, orig_port, resp_port from c where service is not null union all select 'parsed packets', service, coalesce(pkt_count, 0), orig_port, resp_port from c where service is not null)
select kind, name, port, sum(case when side = 'orig' then n else 0 end)::bigint n_orig, sum(case when side = 'resp' then n else 0 end)::bigint n_resp from (select kind, name, n, s port, 'orig' side from x union all select kind, name, n, e, 'resp' from x) where port is not null group by all""",
}
