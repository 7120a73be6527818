"""Tables as the three grains of traffic: packets, connections, sessions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.addresses import canonical_address, endpoint_address, endpoint_port, ip_bytes, ipv4_number, ipv4_text
from packetloom.operators.conntrack import Timeouts
from packetloom.operators.trace import SCHEMA, sessions_of, trace_connections
from packetloom.plans.staging import stage
from packetloom.sources.tables import micros, table


@dataclass(frozen=True)
class Traffic:
    """packets: the packet schema with conn_id and dir, or None. connections: one row each. sessions: conn_id, session_id,
    protocol and the struct of that protocol; the structs of others are null.

    whole: connections with the array of their sessions, where both come from one table, so that no join is needed to have
    them together. frames: pkt_id and frame of packets, where these need no connection."""

    packets: DataFrame | None
    connections: DataFrame
    sessions: DataFrame
    whole: DataFrame | None = None
    frames: DataFrame | None = None


def connection_rows(spark: SparkSession, d: str) -> DataFrame:
    """connections, each once, with addresses in one spelling and in binary."""
    c = table(spark, d, "connections").distinct()
    tup = F.col("five_tuple")
    c = c.select(
        "conn_id", endpoint_address(tup["orig"]).alias("orig"), endpoint_port(tup["orig"]).alias("orig_port"), endpoint_address(tup["resp"]).alias("resp"), endpoint_port(tup["resp"]).alias("resp_port"),
        tup["proto"].alias("proto"), micros("start_ts").alias("first_us"), micros("last_ts").alias("last_us"), "history", "service", "pkt_count", "byte_count", "interarrivals_ctos", "interarrivals_stoc",
    )
    six = F.col("orig").contains(":")
    return c.withColumns({
        "ip_version": F.when(six, 6).otherwise(4), "orig_addr": ipv4_number(F.col("orig")), "resp_addr": ipv4_number(F.col("resp")), "orig_ip": ip_bytes(F.col("orig")), "resp_ip": ip_bytes(F.col("resp")),
        "duration_us": F.greatest(F.lit(0), F.coalesce(F.col("last_us") - F.col("first_us"), F.lit(0))),
    })


def dns_sessions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dns_transactions").distinct()
    none = F.array().cast("array<string>")
    r = F.col("response")
    reply = F.when(r.isNotNull(), F.struct(r["response_code"].alias("response_code"), r["authoritative"].alias("authoritative"), r["recursion_available"].alias("recursion_available"), r["num_answers"].alias("num_answers"), r["answers"].alias("answers"), none.alias("nameservers"), none.alias("additionals")))
    return t.select("conn_id", "session_id", F.lit("dns").alias("protocol"), F.struct("transaction_id", "query", reply.alias("response")).alias("dns"))


def ssh_sessions(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ssh_handshakes").distinct()
    return t.select("conn_id", "session_id", F.lit("ssh").alias("protocol"), F.struct("client_version_exchange", "server_version_exchange", "key_exchange").alias("ssh"))


def traffic_from_tables(spark: SparkSession, d: str) -> Traffic:
    sessions = dns_sessions(spark, d).unionByName(ssh_sessions(spark, d), allowMissingColumns=True)
    return Traffic(None, connection_rows(spark, d), sessions)


def address_text(raw: str) -> F.Column:
    """Text of 4 or 16 bytes."""
    number = F.conv(F.hex(raw), 16, 10).cast("bigint")
    groups = F.concat_ws(":", *[F.substring(F.lower(F.hex(raw)), 4 * i + 1, 4) for i in range(8)])
    return F.when(F.length(raw) == 4, ipv4_text(number)).otherwise(canonical_address(groups))


def connection_columns(c: DataFrame) -> DataFrame:
    """Traced connections with what filters and data ask for: addresses as text and number, duration, packet lists."""
    pick = {"packets": lambda x: F.lit(True), "packets_orig": lambda x: x["dir"], "packets_resp": lambda x: ~x["dir"]}
    lists = {n: F.transform(F.filter("packet_ids", of), lambda x: x["pkt_id"]).alias(n) for n, of in pick.items() if "packet_ids" in c.columns}
    number = lambda x: F.when(F.length(x) == 4, F.conv(F.hex(x), 16, 10).cast("bigint"))
    return c.select("*", *lists.values()).withColumns({"orig": address_text("orig_ip"), "resp": address_text("resp_ip"), "orig_addr": number("orig_ip"), "resp_addr": number("resp_ip"), "duration_us": F.col("last_us") - F.col("first_us")})


#: Columns of a traced connection that grow with it, and what is made of them.
_GROWING = {
    "interarrivals_ctos": (), "interarrivals_stoc": (), "orig_flow": (), "resp_flow": (), "packets_orig_reassembled": (), "packets_resp_reassembled": (),
    "packet_ids": ("packets", "packets_orig", "packets_resp", "frame", "vlan_tci", "eth_src", "eth_dst"),
}


def traffic_from_frames(frames: DataFrame, protocols: set[str], timeouts: Timeouts = Timeouts(), most_out_of_order: int = 100, needs: set[str] | None = None) -> Traffic:
    """Traffic of decoded frames with all packets of each connection; only the protocols named are parsed.

    The traced connections are staged, as packets, sessions and records are all made from them. needs: of the columns that
    grow with a connection only those that subscriptions read (Subscription.needs); None for all. Without packet ids the
    traffic has no packets. Joins by packet are merged: sizes estimated from staged files are far too small to broadcast by.
    """
    growing = [n for n, made in _GROWING.items() if needs is None or needs & {n, *made}]
    columns = [n for n in frames.sparkSession.createDataFrame([], SCHEMA).columns if n not in _GROWING or n in growing]
    c = stage(trace_connections(frames, protocols, timeouts, most_out_of_order, bool({*growing} - {"orig_flow", "resp_flow"}), columns), "connections")
    conns, packets = connection_columns(c), None
    if "packet_ids" in growing:
        ids = c.select("conn_id", F.explode("packet_ids").alias("p")).select("conn_id", "p.pkt_id", "p.dir")
        packets = frames.join(ids.hint("merge"), "pkt_id")
        statics = [x for x in ("vlan_tci", "eth_src", "eth_dst") if x in frames.columns and (needs is None or x in needs)]
        if statics:  # of the first packet
            first = frames.select("pkt_id", *statics).hint("merge")
            conns = conns.withColumn("__first", F.col("packet_ids")[0]["pkt_id"]).join(first, F.col("__first") == F.col("pkt_id"), "left").drop("__first", "pkt_id")
    conns = conns.drop("packet_ids")
    bare = frames.select("pkt_id", "frame") if "frame" in frames.columns else None
    return Traffic(packets, conns.drop("sessions"), sessions_of(c), conns, bare)
