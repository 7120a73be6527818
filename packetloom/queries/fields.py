"""Queries on every field that filters may ask for, on what the filter language makes of a text, and on sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.filterlang import Filter, errors
from packetloom.filterlang import fields as R
from packetloom.filterlang.normalize import pruned
from packetloom.functions.addresses import ip_bytes
from packetloom.functions.headers import decode, payload
from packetloom.observe import histogram
from packetloom.operators import conntrack as C
from packetloom.operators.trace import fold
from packetloom.plans.staging import claim
from packetloom.plans.subscribe import read_subscriptions
from packetloom.queries.flows import _XE
from packetloom.queries.protocols import _ENDS, _HTTP_SQL, _TLS_SQL, SQL as _PROTOCOLS, WHOLE, _closing_frames, _http_frames, _parsed, _tls_frames
from packetloom.sources import pcap, sinks
from packetloom.sources.adapters import packets_from_events
from packetloom.sources.conversations import hexed
from packetloom.sources.tables import table
from packetloom.sources.traffic import address_text
from packetloom.streaming.subscribed import firings

# Header fields: frames whose every field is arithmetic on the packet's id, which SQL repeats

#: Of a packet's id i: version (every third is IPv6), transport (every second UDP), and each field by header.
_V6, _UDP = "i % 3 = 0", "i % 2 = 1"
_IHL, _OFF = "(5 + i % 3)", "(5 + i % 4)"
_IP4 = {
    "version": "4", "ihl": _IHL, "version_ihl": f"64 + {_IHL}", "dscp": "i % 64", "ecn": "i // 64 % 4", "dscp_ecn": "i % 64 * 4 + i // 64 % 4", "type_of_service": "i % 64 * 4 + i // 64 % 4",
    "total_length": f"{_IHL} * 4 + case when {_UDP} then 8 else {_OFF} * 4 end + i % 5", "identification": "i * 7 % 65536", "flags_to_fragment_offset": "i * 11 % 65536", "flags": "i * 11 % 65536 // 8192", "rf": "i * 11 % 65536 // 32768", "df": "i * 11 % 65536 // 16384 % 2",
    "mf": "i * 11 % 65536 // 8192 % 2", "fragment_offset": "i * 11 % 8192", "time_to_live": "i % 256", "protocol": f"case when {_UDP} then 17 else 6 end", "header_checksum": "i * 13 % 65536", "src_addr": "i * 2654435761 % 4294967296", "dst_addr": "i * 40503 % 4294967296",
}
_IP6 = {
    "version": "6", "dscp": "i % 64", "ecn": "i // 64 % 4", "traffic_class": "i % 64 * 4 + i // 64 % 4", "flow_label": "i * 17 % 1048576", "version_to_flow_label": "6 * 268435456 + (i % 64 * 4 + i // 64 % 4) * 1048576 + i * 17 % 1048576",
    "payload_length": f"case when {_UDP} then 8 else {_OFF} * 4 end + i % 5", "next_header": f"case when {_UDP} then 17 else 6 end", "hop_limit": "i * 3 % 256",
}
_TCP = {
    "src_port": "i * 5 % 65536", "dst_port": "i * 9 % 65536", "seq_no": "i * 65537 % 4294967296", "ack_no": "i * 65539 % 4294967296", "data_offset": _OFF, "reserved": "i // 4 % 8", "data_offset_to_ns": f"{_OFF} * 16 + i // 4 % 8 * 2 + i // 32 % 2", "ns": "i // 32 % 2", "flags": "i * 3 % 256",
    "window": "i * 19 % 65536", "checksum": "i * 23 % 65536", "urgent_pointer": "i * 29 % 65536", "cwr": "i * 3 // 128 % 2", "ece": "i * 3 // 64 % 2", "urg": "i * 3 // 32 % 2", "ack": "i * 3 // 16 % 2", "psh": "i * 3 // 8 % 2", "rst": "i * 3 // 4 % 2", "syn": "i * 3 // 2 % 2", "fin": "i * 3 % 2",
    "synack": "case when i * 3 // 2 % 2 = 1 or i * 3 // 16 % 2 = 1 then 1 else 0 end",
}
_UDP_ = {"src_port": "i * 5 % 65536", "dst_port": "i * 9 % 65536", "length": "8 + i % 5", "checksum": "i * 23 % 65536"}


def _spark(sql: str) -> Column:
    return F.expr(sql.replace("//", "div"))


def _every_field(spark: SparkSession, d: str) -> DataFrame:
    """Decoded frames of every packet's id: tagged or not, IPv4 with options or IPv6, TCP with options or UDP."""
    i = table(spark, d, "packets").select(F.col("pkt_id").alias("i"), "vlan_tci").distinct()
    h = lambda sql, n: hexed(_spark(sql), n)
    eth = F.concat(h("i * 31 % 281474976710656", 6), h("i * 37 % 281474976710656", 6), F.when(F.col("vlan_tci").isNotNull(), F.concat(F.lit("8100"), hexed("vlan_tci", 2))).otherwise(F.lit("")))
    v4 = F.concat(F.lit("0800"), h(_IP4["version_ihl"], 1), h(_IP4["dscp_ecn"], 1), h(_IP4["total_length"], 2), h(_IP4["identification"], 2), h(_IP4["flags_to_fragment_offset"], 2), h(_IP4["time_to_live"], 1), h(_IP4["protocol"], 1), h(_IP4["header_checksum"], 2), h(_IP4["src_addr"], 4), h(_IP4["dst_addr"], 4), F.repeat(F.lit("00000000"), _spark(f"cast({_IHL} - 5 as int)")))
    net = lambda n: F.concat(F.lit("20010DB8"), hexed(F.col("i") * n, 12))
    v6 = F.concat(F.lit("86DD"), h(_IP6["version_to_flow_label"], 4), h(_IP6["payload_length"], 2), h(_IP6["next_header"], 1), h(_IP6["hop_limit"], 1), net(41), net(43))
    tcp = F.concat(h(_TCP["src_port"], 2), h(_TCP["dst_port"], 2), h(_TCP["seq_no"], 4), h(_TCP["ack_no"], 4), h(_TCP["data_offset_to_ns"], 1), h(_TCP["flags"], 1), h(_TCP["window"], 2), h(_TCP["checksum"], 2), h(_TCP["urgent_pointer"], 2), F.repeat(F.lit("01010101"), _spark(f"cast({_OFF} - 5 as int)")))
    udp = F.concat(h(_UDP_["src_port"], 2), h(_UDP_["dst_port"], 2), h(_UDP_["length"], 2), h(_UDP_["checksum"], 2))
    frame = F.unhex(F.concat(eth, F.when(_spark(_V6), v6).otherwise(v4), F.when(_spark(_UDP), udp).otherwise(tcp), F.repeat(F.lit("70"), _spark("cast(i % 5 as int)"))))
    return decode(i.select(F.col("i").alias("pkt_id"), frame.alias("frame")))


def _of(proto: str, cond: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        x = _every_field(spark, d)
        own = lambda n: R.header_column(proto, n.replace("addr", "ip") if proto == "ipv6" else n, set(x.columns))
        cols = [F.hex(own(n)).alias(n) if proto == "ipv6" and n.endswith("addr") else own(n).cast("bigint").alias(n) for n in R.HEADER_FIELDS[proto]]
        return x.where(cond).select("pkt_id", *cols)

    return run


def fld_ethernet(spark: SparkSession, d: str) -> DataFrame:
    x = _every_field(spark, d)
    return x.select("pkt_id", F.hex("eth_dst").alias("dst"), F.hex("eth_src").alias("src"), "ether_type", F.coalesce("vlan_tci", F.lit(-1)).alias("tci"))


# Session fields


def _session_fields(frames, protocol: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        s = _parsed(frames(spark, d), protocol)
        return s.select("conn", *[(F.hex(made()) if kind == R.BYTES else made()).alias(n) for n, (kind, made) in R.SESSION_FIELDS[protocol].items()])

    return run


# What the filter language makes of a text

#: text: patterns with their layers, by hand. Spellings, order of alternatives, blanks and line breaks, expansion, pruning.
CANONICAL = {
    "tcp": ["ipv4, tcp", "ipv6, tcp"], "  tcp\n and\n  ipv4 ": ["ipv4, tcp"], "ipv4 && tcp || udp and ipv4": ["ipv4, tcp", "ipv4, udp"], "(ipv4 or ipv6) AND udp": ["ipv4, udp", "ipv6, udp"], "": [""],
    "ipv4.addr = 1.2.3.4": ["ipv4, ipv4.dst_addr = 1.2.3.4/32", "ipv4, ipv4.src_addr = 1.2.3.4/32"], "ipv4.addr != 1.2.3.4": ["ipv4, ipv4.dst_addr != 1.2.3.4/32, ipv4.src_addr != 1.2.3.4/32"],
    "ipv4.src_addr in 10.1.2.3/8": ["ipv4, ipv4.src_addr in 10.0.0.0/8"], "ipv6.dst_addr = 2001:db8::1": ["ipv6, ipv6.dst_addr = 2001:db8::1/128"], "ipv4 and tcp.dst_port in 80..90": ["ipv4, tcp, tcp.dst_port in 80..90"], "ipv4 and tcp.dst_port ge 80 and tcp.dst_port ge 80": ["ipv4, tcp, tcp.dst_port >= 80"],
    "ipv4 and tls.sni matches 'a b'": ["ipv4, tcp, tls, tls.sni ~ 'a b'"], "ipv4 and ssh.key_exchange_cookie_stoc !contains |0A ff|": ["ipv4, tcp, ssh, ssh.key_exchange_cookie_stoc not contains |0a ff|"], "quic and ipv6": ["ipv6, udp, quic"], "dns and ipv4": ["ipv4, tcp, dns", "ipv4, udp, dns"],
    "ipv4 or ipv4 and tcp or ipv4.src_addr = 1.1.1.1": ["ipv4"], "ipv4.src_addr in 10.0.0.0/8 or ipv4.src_addr in 10.1.0.0/16": ["ipv4, ipv4.src_addr in 10.0.0.0/8"], "ipv4 and (tcp.dst_port = 2 or tcp.dst_port = 1)": ["ipv4, tcp, tcp.dst_port = 1", "ipv4, tcp, tcp.dst_port = 2"],
}
#: text: the error it raises, by hand.
BROKEN = {
    "tcp.port = ": "InvalidFormat", "(tcp": "InvalidFormat", "tcp.portal": "InvalidFormat", "http.uri = ''": "InvalidFormat", "gopher": "InvalidProtocol", "tcp and udp": "InvalidPatternLayers", "tcp.color = 1": "InvalidField", "quic.version = 1": "InvalidField", "tcp.port ~ 'x'": "InvalidRhsType", "ipv6.addr = 1.2.3.4": "InvalidRhsType",
    "tcp.port contains 5": "InvalidBinOp", "tls.sni in 'x'": "InvalidBinOp", "tcp.port in 9..2": "InvalidIntRange", "tcp.port in 5..5": "InvalidIntRange", "ipv4.addr = 1.2.3.400": "InvalidAddress", "ipv4.addr = 1.2.3.4/40": "InvalidPrefixLen", "tcp.port = 99999999999999999999999": "InvalidInt", "http.uri = |ABCD|": "InvalidRhsValue",
}
#: text: stage, whether it asks for fields of single packets, parsers needed, by hand.
STAGES = {
    "tcp.port = 1": ("packet", False, ""), "tls and tcp.port = 1": ("protocol", False, "tls"), "tls.sni = 'x' or dns": ("session", False, "dns,tls"), "tcp.syn = 1": ("packet", True, ""), "ipv4.time_to_live > 5 and ssh": ("protocol", True, "ssh"), "ipv4.src_addr = 1.1.1.1 and http.uri = 'x'": ("session", False, "http"), "": ("packet", False, ""),
}


def flt_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Patterns of filters: qualified, sorted, each once, those that others make superfluous left out."""
    shown = lambda q: ", ".join(str(p) for p in q if p.proto != "ethernet")
    return spark.createDataFrame([(t, shown(q)) for t in CANONICAL for q in pruned(Filter(t).patterns)], "filter string, pattern string")


def flt_errors(spark: SparkSession, d: str) -> DataFrame:
    def raised(text: str) -> str:
        try:
            Filter(text)
        except errors.FilterError as e:
            return type(e).__name__
        return "none"

    return spark.createDataFrame([(t, raised(t)) for t in BROKEN], "filter string, error string")


def flt_stages(spark: SparkSession, d: str) -> DataFrame:
    made = {t: Filter(t) for t in STAGES}
    return spark.createDataFrame([(t, f.stage(), f.per_packet(), ",".join(sorted(f.protocols()))) for t, f in made.items()], "filter string, stage string, per_packet boolean, parsers string")


# Payloads, users' aggregates, timings, sources and sinks


def fn_payload(spark: SparkSession, d: str) -> DataFrame:
    """The bytes behind the headers of every packet that has any."""
    x = decode(_closing_frames(spark, d)).where("payload_len > 0")
    return x.select("pkt_id", payload().cast("string").alias("said"))


def fn_ip_text(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of packets as text, those of IPv6 also read back from it."""
    p = table(spark, d, "packets").select("pkt_id", "ip_version", "dst_ip").distinct()
    text = address_text("dst_ip")
    return p.select("pkt_id", F.when(F.col("ip_version") == 4, text).otherwise(F.hex(ip_bytes(text))).alias("dst"), F.length(text).between(3, 39).alias("plausible"))


def str_spec(spark: SparkSession, d: str) -> DataFrame:
    """Streaming subscriptions of a TOML specification over TLS connections: bytes at every packet, and every fourth."""
    text = """
[[subscriptions]]
filter = "tls"
datatypes = ["ByteCount", "FiveTuple"]
callback = "each"
streaming = { Packets = 1 }
[[subscriptions]]
filter = "tls and tcp.port = 443"
datatypes = ["ByteCount", "FiveTuple"]
callback = "fourth"
streaming = { Packets = 4 }
"""
    frames, out = decode(_tls_frames(spark, d), names=[]), None
    for sub in read_subscriptions(text):
        one = firings(sub, frames, WHOLE).select(F.lit(sub.name).alias("callback"), "pkt_id", F.col("ByteCount").alias("byte_count"), F.col("firing").cast("bigint").alias("firing"))
        out = one if out is None else out.unionByName(one)
    return out


def src_stream(spark: SparkSession, d: str) -> DataFrame:
    """Captures taken up by a stream, written by it, and read back."""
    captures, into = claim(spark, "arriving"), claim(spark, "streamed")
    pcap.write(_closing_frames(spark, d), captures)
    frames = spark.readStream.format("pcap").load(captures).select("pkt_id", "ts", "frame_len")
    q = frames.writeStream.format("parquet").option("checkpointLocation", claim(spark, "progress")).start(into)
    q.processAllAvailable()
    q.stop()
    return spark.read.schema("pkt_id bigint, ts timestamp, frame_len int").parquet(into).groupBy("frame_len").agg(F.count(F.lit(1)).alias("n"), F.min(F.unix_micros("ts")).alias("first_us"))


class _Turns:
    """The largest frame of a connection, and how often its direction changes."""

    def __init__(self) -> None:
        self.size, self.turns, self.last = 0, 0, None

    def update(self, frame_len: int, dir: bool) -> None:
        self.size = max(self.size, frame_len)
        self.turns += self.last is not None and self.last != dir
        self.last = dir

    def result(self) -> dict:
        return {"largest": self.size, "turns": self.turns}


def udf_tracked(spark: SparkSession, d: str) -> DataFrame:
    """A user's own aggregate over the packets of each connection."""
    x = fold(C.assign(packets_from_events(spark, d), C.Timeouts(establish=120_000_000)), ["frame_len", "dir"], _Turns, "largest bigint, turns bigint")
    return x.select(F.hex("key_hi").alias("hi"), F.hex("key_lo").alias("lo"), "proto", F.col("conn_no").cast("bigint").alias("conn_no"), "largest", "turns")


def obs_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Whether each percentile of the histogram lies at its rank, within the ten-thousandth it promises."""
    p = table(spark, d, "packets").select("pkt_id", "frame_len").distinct()
    found = histogram(p, "frame_len").collect()[0].asDict()
    v, n = F.col("frame_len"), F.count(F.lit(1))
    share = lambda name: float(f"0.{name[1:]}")
    below = lambda x: F.sum(F.when(v < x, 1).otherwise(0))
    upto = lambda x: F.sum(F.when(v <= x, 1).otherwise(0))
    return p.agg(*[((below(x) <= n * (share(k) + 1e-4)) & (upto(x) >= n * (share(k) - 1e-4))).alias(k) for k, x in found.items()])


def src_ports(spark: SparkSession, d: str) -> DataFrame:
    """Captures of two ports as one table with the port's number, the same frames written for each."""
    out = None
    for port in (0, 1):
        path = claim(spark, f"port{port}")
        pcap.write(_closing_frames(spark, d).where(F.floor(F.col("pkt_id") / 4096) % 2 == port), path)
        one = pcap.read(spark, path).withColumn("port_id", F.lit(port))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("port_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("frame_len").cast("bigint")).alias("bytes"))


def _services(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "connections").select("conn_id", "service").distinct().groupBy("service").agg(F.count(F.lit(1)).alias("n"))


def snk_json(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as JSON lines, bytes in base64, and read back."""
    path = claim(spark, "json")
    sinks.write_json(table(spark, d, "ssh_handshakes").select("session_id", "conn_id", F.col("key_exchange.cookie").alias("cookie")).distinct(), path)
    return spark.read.schema("session_id bigint, conn_id string, cookie binary").json(path).select("session_id", "conn_id", F.hex("cookie").alias("cookie"))


def snk_log(spark: SparkSession, d: str) -> DataFrame:
    """Figures appended to a CSV log, and read back."""
    path = claim(spark, "log")
    sinks.write_log(_services(spark, d), path)
    return spark.read.schema("service string, n bigint").option("header", True).csv(path)


def snk_exposition(spark: SparkSession, d: str) -> DataFrame:
    """Counters by label in the text format of metric collectors."""
    return spark.createDataFrame([(x,) for x in sinks.exposition(_services(spark, d), "connections", ["service"])], "line string")


QUERIES = {
    "fld_ipv4": _of("ipv4", "ip_version = 4"), "fld_ipv6": _of("ipv6", "ip_version = 6"), "fld_tcp": _of("tcp", "proto = 6"), "fld_udp": _of("udp", "proto = 17"), "fld_http": _session_fields(_http_frames, "http"), "fld_tls": _session_fields(_tls_frames, "tls"),
    **{f.__name__: f for f in (fld_ethernet, flt_canonical, flt_errors, flt_stages, fn_payload, fn_ip_text, str_spec, src_stream, udf_tracked, obs_histogram, src_ports, snk_json, snk_log, snk_exposition)},
}


def _values(rows: list[tuple], names: str) -> str:
    text = lambda v: str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return f"select * from (values {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) t({names})"


_I = "with p as (select distinct pkt_id i, vlan_tci from packets)"
_cols = lambda fields: ", ".join(f'({sql})::bigint "{n}"' for n, sql in fields.items())
_SERVICES = "(select service, count(*)::bigint n from (select distinct conn_id, service from connections) group by service)"
SQL = {
    "fld_ipv4": f"{_I} select i pkt_id, {_cols(_IP4)} from p where not ({_V6})",
    "fld_ipv6": f"{_I} select i pkt_id, {_cols(_IP6)}, '20010DB8' || printf('%024X', i * 41) src_addr, '20010DB8' || printf('%024X', i * 43) dst_addr from p where {_V6}",
    "fld_tcp": f"{_I} select i pkt_id, {_cols(_TCP)} from p where not ({_UDP})",
    "fld_udp": f"{_I} select i pkt_id, {_cols(_UDP_)} from p where {_UDP}",
    "fld_ethernet": f"{_I} select i pkt_id, printf('%012X', i * 31 % 281474976710656) dst, printf('%012X', i * 37 % 281474976710656) src, case when {_V6} then 34525 else 2048 end::int ether_type, coalesce(vlan_tci, -1) tci from p",
    "fld_http": f"""{_HTTP_SQL} select conn, '/orders/' || o_orderkey || '?p=' || substr(o_orderpriority, 1, 1) uri, case when o_orderkey % 4 = 3 then 'POST' else 'GET' end as method, 'HTTP/1.1' request_version, 'probe/' || o_orderkey % 5 user_agent, '' cookie, 'c' || conn || '.example' host,
  case when o_orderkey % 4 = 3 then o_orderkey % 7 else 0 end::bigint request_content_length, '' request_content_type, '' request_transfer_encoding, case when answered then 'HTTP/1.1' else '' end response_version, case when not answered then 0 when o_orderstatus = 'O' then 200 when o_orderstatus = 'F' then 404 else 500 end::bigint status_code,
  case when not answered then '' when o_orderstatus = 'O' then 'OK' when o_orderstatus = 'F' then 'Not Found' else 'Oh no' end status_msg, case when answered then o_orderkey % 7 else 0 end::bigint response_content_length, case when answered then 'text/plain' else '' end response_content_type, '' response_transfer_encoding from a""",
    "fld_tls": f"""{_TLS_SQL}, x as (select *, '771,4865,' || case when conn % 3 <> 0 then '43' else '' end ja3s_str, upper(md5(conn::varchar) || md5(name)) random from j)
select conn, sni, 771::bigint client_version, 771::bigint server_version, case when conn % 3 <> 0 then 772 else 771 end::bigint as version, 4865::bigint cipher, 0::bigint compression_alg, random client_random, random server_random, ja3_str, md5(ja3_str) ja3_hash, ja3s_str, md5(ja3s_str) ja3s_hash from x""",
    "flt_canonical": _values([(t, q) for t, found in CANONICAL.items() for q in found], "filter, pattern"),
    "flt_errors": _values(list(BROKEN.items()), "filter, error"),
    "flt_stages": _values([(t, *x) for t, x in STAGES.items()], "filter, stage, per_packet, parsers"),
    "fn_payload": "select o_orderkey * 4096 + 3 pkt_id, repeat('q', (o_orderkey % 50 + 1)::int) said from orders union all select o_orderkey * 4096 + 4, repeat('r', (o_custkey % 90 + 1)::int) from orders",
    "fn_ip_text": "select distinct pkt_id, case when ip_version = 4 then concat_ws('.', dst_addr >> 24, (dst_addr >> 16) & 255, (dst_addr >> 8) & 255, dst_addr & 255) else hex(dst_ip) end dst, true plausible from packets",
    "str_spec": f"with e as ({_PROTOCOLS['str_protocol_filter']}) select 'each' callback, pkt_id, byte_count, firing from e union all select 'fourth', pkt_id, byte_count, ((firing - 1) // 4 + 1)::bigint from e where (firing - 1) % 4 = 0",
    "src_stream": f"""with p as (select o_orderkey conn, o_orderkey % 50 + 1 up, o_custkey % 90 + 1 down, unnest(range(0, 5 + {_ENDS})) k from orders)
select (54 + case k when 3 then up when 4 then down else 0 end)::int frame_len, count(*)::bigint n, min(1700000000000000 + conn * 20000 + k * 1000) first_us from p group by 1""",
    "udf_tracked": f"""{_XE}, t as (select *, own <> lag(own) over (partition by hi, lo, proto, conn_no order by us, pkt_id) turn from r)
select hi, lo, proto, conn_no::bigint conn_no, max(frame_len)::bigint largest, count(*) filter (turn)::bigint turns from t group by t.hi, t.lo, proto, t.conn_no""",
    "obs_histogram": "select true p05, true p25, true p50, true p75, true p95, true p99, true p999",
    "src_ports": f"select (o_orderkey % 2)::int port_id, sum(5 + {_ENDS})::bigint n, sum(54 * (5 + {_ENDS}) + o_orderkey % 50 + 1 + o_custkey % 90 + 1)::bigint bytes from orders group by 1",
    "snk_json": "select distinct session_id, conn_id, hex(key_exchange.cookie) cookie from ssh_handshakes",
    "snk_log": f"select * from {_SERVICES}",
    "snk_exposition": f"select '# TYPE connections counter' line union all select 'connections{{service=\"' || coalesce(service, 'None') || '\"}} ' || n from {_SERVICES}",
}
