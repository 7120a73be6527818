"""Packet rows made from the events table by integer arithmetic, the same in SQL.

A user is an originator; event types set the TCP flags; time is compressed so that flows both go on and expire.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.sources.tables import table

DIVISOR = 300

_SHARED = """
  event_id as pkt_id, {us} div {divisor} as us, event_id % 2 = 0 as fwd, case when user_id % 3 = 0 then 17 else 6 end as proto,
  167772160 + user_id as a, 3232235776 + user_id % 16 as b, 1024 + (user_id * 7) % 50000 as ap, {ports} as bp,
  cast(floor(value) as bigint) as size, case event_type when 'signup' then 2 when 'click' then 16 when 'view' then 24 when 'purchase' then 17 else 4 end as bits
"""
_PORTS = "case user_id % 5 when 0 then 443 when 1 then 80 when 2 then 53 when 3 then 22 else 8080 end"

#: The packet rows for DuckDB, to stand before a query as `with pk as (...)`.
PACKETS_SQL = f"""
with e as (select {_SHARED.format(us="epoch_us(ts)", divisor=DIVISOR, ports=_PORTS).replace(" div ", " // ")} from events),
pk as (select pkt_id, us, proto, case when fwd then a else b end src, case when fwd then b else a end dst, case when fwd then ap else bp end sport, case when fwd then bp else ap end dport,
  case when proto = 6 then bits else 0 end flags, size payload_len, size + case when proto = 6 then 54 else 42 end frame_len from e)
"""


def packets_from_events(spark: SparkSession, d: str) -> DataFrame:
    """Packets in the packet schema; user_id, event_id and ts are never null in the table."""
    e = table(spark, d, "events").withColumn("__us", F.unix_micros(F.col("ts").cast("timestamp")))
    e = e.selectExpr(*[x.strip() for x in _split(_SHARED.format(us="__us", divisor=DIVISOR, ports=_PORTS))])
    pick = lambda yes, no: F.when(F.col("fwd"), F.col(yes)).otherwise(F.col(no))
    flat = e.select("pkt_id", F.timestamp_micros("us").alias("ts"), F.lit(4).alias("ip_version"), pick("a", "b").cast("bigint").alias("src_addr"), pick("b", "a").cast("bigint").alias("dst_addr"), pick("ap", "bp").cast("int").alias("src_port"), pick("bp", "ap").cast("int").alias("dst_port"), "proto", F.when(F.col("proto") == 6, F.col("bits")).otherwise(0).alias("tcp_flags"), F.col("size").cast("int").alias("payload_len"), (F.col("size") + F.when(F.col("proto") == 6, 54).otherwise(42)).cast("int").alias("frame_len"))
    raw = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    return flat.withColumns({"src_ip": raw("src_addr"), "dst_ip": raw("dst_addr"), "seq_no": F.col("pkt_id") * 500, "ack_no": F.lit(0).cast("bigint")})


#: Times of the sample are divided by this, so that packets of a flow come close enough to make connections.
FLOW_DIVISOR = 100
#: Flows of the packets table for DuckDB, to stand before a query as `with pk as (...)`. Ends are hexadecimal text.
FLOWS_SQL = """
with pk as (select distinct pkt_id, epoch_us(ts) // {div} us, proto, {end_s} se, {end_d} de, coalesce(tcp_flags, 0) flags, payload_len, frame_len, seq_no from packets
  where proto in (6, 17) and src_port is not null and dst_port is not null and src_ip is not null and dst_ip is not null and ts is not null)
"""
_END = "case when ip_version = 4 then substr(hex({p}_ip), 1, 4) || '0000' else substr(hex({p}_ip), 1, 8) || repeat('0', 24) end || printf('%04X', case when {p}_port < 1024 then {p}_port else 40000 end)"
FLOWS_SQL = FLOWS_SQL.format(div=FLOW_DIVISOR, end_s=_END.format(p="src"), end_d=_END.format(p="dst"))


def flows_from_packets(spark: SparkSession, d: str) -> DataFrame:
    """Packets of the packets table, each once, as flows between networks: addresses are cut to 16 bits of IPv4 and 32 of
    IPv6, ports that are not well known are one, and times lie closer together, so that packets of a sample come to have others of their flow."""
    p = table(spark, d, "packets").select("pkt_id", "ts", "ip_version", "src_ip", "dst_ip", "src_port", "dst_port", "proto", "tcp_flags", "seq_no", "ack_no", "payload_len", "frame_len").distinct()
    net = lambda c: F.when(F.col("ip_version") == 4, F.concat(F.substring(c, 1, 2), F.lit(bytes(2)))).otherwise(F.concat(F.substring(c, 1, 4), F.lit(bytes(12))))
    port = lambda c: F.when(F.col(c) < 1024, F.col(c)).when(F.col(c).isNotNull(), 40000)
    p = p.withColumn("ts", F.timestamp_micros(F.expr(f"unix_micros(cast(ts as timestamp)) div {FLOW_DIVISOR}")))
    return p.withColumns({"src_ip": net("src_ip"), "dst_ip": net("dst_ip"), "src_port": port("src_port"), "dst_port": port("dst_port")})


def _split(text: str) -> list[str]:
    """Top-level commas of a select list."""
    out, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[last:i])
            last = i + 1
    return [*out, text[last:]]
