"""Queries on parsed sessions: tables written as connections on the wire, decoded, traced and parsed back whole."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.addresses import ip_bytes
from packetloom.functions.fingerprints import ja3_string, ja3s_string
from packetloom.functions.headers import decode, payload
from packetloom.operators.conntrack import Timeouts
from packetloom.observe import tracking_counters
from packetloom.operators.trace import sessions_of, trace_connections
from packetloom.plans.staging import claim
from packetloom.plans.subscribe import Subscription, deliver
from packetloom.queries.services import _C
from packetloom.sources import pcap, samples
from packetloom.sources.conversations import PLACES, ascii_hex, block, conversation_of, frames_of, hexed, turn
from packetloom.sources.tables import table
from packetloom.sources.traffic import Traffic, traffic_from_frames, traffic_from_tables
from packetloom.streaming.subscribed import firings

WHOLE = Timeouts(offline=True)


def _conn() -> Column:
    return conversation_of(F.col("orig_ip"), F.col("orig_port")).alias("conn")


_ENDS_OF = ["conn_id", "orig_ip", "orig_port", "resp_ip", "resp_port"]


def _traced(frames: DataFrame, *protocols: str, columns: tuple[str, ...] = ("sessions",)) -> DataFrame:
    return trace_connections(decode(frames, names=[]), set(protocols), WHOLE, lists=False, columns=[*_ENDS_OF, *columns])


def _parsed(frames: DataFrame, protocol: str) -> DataFrame:
    """conn and the columns of each session."""
    s = _traced(frames, protocol).select(_conn(), F.explode("sessions").alias("s"))
    return s.where(F.col("s.protocol") == protocol).select("conn", f"s.{protocol}")


def _traffic(frames: DataFrame, sub: Subscription) -> Traffic:
    """Traffic with what one subscription reads."""
    return traffic_from_frames(decode(frames, names=[]), sub.protocols, WHOLE, needs=sub.needs)


# HTTP: the orders of a customer, asked for in one pipeline


def _http_frames(spark: SparkSession, d: str) -> DataFrame:
    """All requests of a customer before all responses; every third customer's last order is not answered. Responses come
    in two segments, the second first."""
    o = table(spark, d, "orders").select("o_custkey", F.struct("o_orderkey", "o_orderstatus", "o_orderpriority").alias("o"))
    c = o.groupBy(F.col("o_custkey").alias("conn")).agg(F.sort_array(F.collect_list("o")).alias("o"))
    post = lambda x: F.pmod(x["o_orderkey"], F.lit(4)) == 3
    body = lambda x: F.repeat(F.lit("x"), F.pmod(x["o_orderkey"], F.lit(7)).cast("int"))

    def ask(x: Column) -> Column:
        line = F.concat(F.when(post(x), F.lit("POST")).otherwise(F.lit("GET")), F.lit(" /orders/"), x["o_orderkey"].cast("string"), F.lit("?p="), F.substring(x["o_orderpriority"], 1, 1), F.lit(" HTTP/1.1\r\nHost: c"), F.col("conn").cast("string"), F.lit(".example\r\nUser-Agent: probe/"), F.pmod(x["o_orderkey"], F.lit(5)).cast("string"))
        return turn(True, ascii_hex(F.concat(line, F.when(post(x), F.concat(F.lit("\r\nContent-Length: "), F.length(body(x)).cast("string"), F.lit("\r\n\r\n"), body(x))).otherwise(F.lit("\r\n\r\n")))))

    def say(x: Column) -> Column:
        code = F.when(x["o_orderstatus"] == "O", F.lit("200 OK")).when(x["o_orderstatus"] == "F", F.lit("404 Not Found")).otherwise(F.lit("500 Oh no"))
        return ascii_hex(F.concat(F.lit("HTTP/1.1 "), code, F.lit("\r\nContent-Type: text/plain\r\nContent-Length: "), F.length(body(x)).cast("string"), F.lit("\r\n\r\n"), body(x)))

    n = F.size("o")
    answered = F.slice("o", F.lit(1), n - F.when(F.pmod("conn", F.lit(3)) == 0, 1).otherwise(0))
    halves = F.flatten(F.transform(answered, lambda x, i: F.array(turn(False, F.substring(say(x), 1, 40), n + 2 * i + 1), turn(False, F.substring(say(x), 41, 100_000), n + 2 * i))))
    return frames_of(c.select("conn", F.concat(F.transform("o", ask), halves).alias("turns"), F.lit("fin").alias("close")), 80)


def prs_http(spark: SparkSession, d: str) -> DataFrame:
    """Requests and responses in pipeline order."""
    s = _parsed(_http_frames(spark, d), "http")
    return s.select("conn", F.col("http.trans_depth").cast("bigint").alias("trans_depth"), "http.request.method", "http.request.uri", "http.request.host", "http.request.user_agent", F.coalesce("http.request.content_length", F.lit(-1)).alias("sent"), F.coalesce(F.col("http.response.status_code").cast("bigint"), F.lit(-1)).alias("status_code"), F.coalesce("http.response.status_msg", F.lit("")).alias("status_msg"), F.coalesce("http.response.content_length", F.lit(-1)).alias("received"))


def stg_packet_deliver(spark: SparkSession, d: str) -> DataFrame:
    """All packets, from the first on, of the connections in which some session matches, by subscription."""
    t = traffic_from_frames(decode(_http_frames(spark, d), names=[]), {"http"}, WHOLE)
    return deliver(Subscription("http.uri ~ '/orders/[0-9]*7\\?p=1' and http.method = 'POST'", ("ZcFrame",)), t).select("pkt_id", F.length("ZcFrame").cast("bigint").alias("frame_len"))


def agg_pktframes(spark: SparkSession, d: str) -> DataFrame:
    """Frames of each connection in order of arrival and of its originator's stream, by subscription."""
    sub = Subscription("http", ("BidirZcPktStream", "OrigPktStream", "RespPktsReassembled", "FiveTuple"))
    rows = deliver(sub, _traffic(_http_frames(spark, d), sub))
    ip = F.unhex(F.concat(*[F.lpad(F.hex(F.split_part("FiveTuple.orig", F.lit("."), F.lit(i)).cast("bigint")), 2, "0") for i in range(1, 5)]))
    text = F.aggregate(F.transform("RespPktsReassembled", lambda f: F.substring(f, 55, 100_000).cast("string")), F.lit(""), lambda a, x: F.concat(a, x))
    return rows.select(conversation_of(ip, F.col("FiveTuple.orig_port")).alias("conn"), F.size("BidirZcPktStream").cast("bigint").alias("n"), F.size("OrigPktStream").cast("bigint").alias("n_orig"), F.regexp_count(text, F.lit("HTTP/1.1 (200|404|500)")).cast("bigint").alias("n_responses"), F.md5(text.cast("binary")).alias("responses"))


def ex_websites(spark: SparkSession, d: str) -> DataFrame:
    """Names asked for over DNS, HTTP, TLS and QUIC, without empty ones, as counters by protocol and name."""
    sites = {
        "dns": ("DnsTransaction", lambda: F.get("DnsTransaction.query.queries", F.lit(0)), lambda s: traffic_from_tables(spark, d)),
        "http": ("HttpTransaction", lambda: F.col("HttpTransaction.request.uri"), lambda s: _traffic(_http_frames(spark, d), s)),
        "tls": ("TlsHandshake", lambda: F.col("TlsHandshake.client_hello.server_name"), lambda s: _traffic(_tls_frames(spark, d), s)),
        "quic": ("QuicStream", lambda: F.col("QuicStream.tls.client_hello.server_name"), lambda s: _traffic(_quic_frames(spark, d), s)),
    }
    out = None
    for protocol, (datatype, site, traffic) in sites.items():
        sub = Subscription(protocol, (datatype,))
        one = deliver(sub, traffic(sub)).select(F.lit(protocol).alias("protocol"), F.coalesce(site(), F.lit("")).alias("website"))
        out = one if out is None else out.unionByName(one)
    return out.where(F.col("website") != "").groupBy("protocol", "website").agg(F.count(F.lit(1)).alias("n"))


def obs_tracking(spark: SparkSession, d: str) -> DataFrame:
    """Counters of tracking: connections that began, and packets dropped because they are in the middle of none. Every fifth
    connection is seen without its first packet."""
    frames = _closing_frames(spark, d).where(~((F.col("pkt_id") % PLACES == 0) & (F.floor(F.col("pkt_id") / PLACES) % 5 == 0)))
    p = decode(frames)
    return tracking_counters(p, trace_connections(p, set(), WHOLE, lists=False, columns=["proto", "pkt_count", "byte_count"]))


def str_session_filter(spark: SparkSession, d: str) -> DataFrame:
    """Packet counts at every packet after the session has matched, and packets since the firing before."""
    sub = Subscription("http.status_code = 404", ("BidirPktStream", "FiveTuple"), streaming=("packets", 3))
    x = firings(sub, decode(_http_frames(spark, d)), WHOLE)
    return x.select("pkt_id", F.col("firing").cast("bigint").alias("firing"), F.array_join(F.transform("BidirPktStream", lambda v: (v % 4096).cast("string")), ",").alias("packets"))


def str_protocol_filter(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of TLS connections at every packet after the protocol is known."""
    sub = Subscription("tls", ("ByteCount", "FilterStr"), streaming=("packets", 1))
    return firings(sub, decode(_tls_frames(spark, d)), WHOLE).select("pkt_id", F.col("ByteCount").alias("byte_count"), F.col("firing").cast("bigint").alias("firing"), "FilterStr")


def agg_sessionlist(spark: SparkSession, d: str) -> DataFrame:
    """Number of sessions in each connection's list."""
    sub = Subscription("http", ("SessionList", "FiveTuple"))
    rows = deliver(sub, _traffic(_http_frames(spark, d), sub))
    ip = F.unhex(F.concat(*[F.lpad(F.hex(F.split_part("FiveTuple.orig", F.lit("."), F.lit(i)).cast("bigint")), 2, "0") for i in range(1, 5)]))
    return rows.select(conversation_of(ip, F.col("FiveTuple.orig_port")).alias("conn"), F.size("SessionList").cast("bigint").alias("n_sessions"))


_HTTP_SQL = """
with r as (select *, o_custkey conn, row_number() over (partition by o_custkey order by o_orderkey) - 1 depth, count(*) over (partition by o_custkey) n from orders),
a as (select *, not (conn % 3 = 0 and depth = n - 1) answered from r)
"""

# TLS: customers as names asked for

#: Cipher suites offered, of which a customer's key picks some; the first may be greased. Groups and formats likewise.
_CIPHERS = (0x1301, 0x1302, 0xC02B, 0xC02F, 0x009C, 0x0035)
_GREASE = 0x0A0A


def _tls_frames(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("conn"), k, F.lower(F.concat(F.regexp_replace("c_name", "#", "-"), F.lit("."), F.coalesce("c_mktsegment", F.lit("none")), F.lit(".example"))).alias("sni"))
    num = lambda x: F.lit(f"{x:04X}")
    when = lambda cond, text: F.when(cond, text).otherwise(F.lit(""))
    ciphers = F.concat(when(k % 2 == 0, num(_GREASE)), *[when(k % (i + 2) != 1, num(x)) for i, x in enumerate(_CIPHERS)], num(0x00FF))
    ext = lambda kind, body: F.concat(num(kind), block(body, 2))
    sni = ext(0, block(F.concat(F.lit("00"), block(ascii_hex(F.col("sni")), 2)), 2))
    groups = ext(10, block(F.concat(when(k % 2 == 0, num(_GREASE)), num(29), when(k % 3 == 0, num(23))), 2))
    exts = F.concat(when(k % 5 != 0, sni), groups, ext(11, block(F.lit("00"), 1)), when(k % 4 == 0, ext(_GREASE, F.lit(""))), ext(43, block(F.concat(num(0x0304), num(0x0303)), 1)))
    random = F.concat(F.md5(k.cast("string").cast("binary")), F.md5(F.col("sni").cast("binary")))
    hello = lambda body, kind: F.concat(F.lit("160301"), block(F.concat(F.lit(kind), block(body, 3)), 2))
    client = hello(F.concat(F.lit("0303"), random, block(F.lit(""), 1), block(ciphers, 2), F.lit("0100"), block(exts, 2)), "01")
    server = hello(F.concat(F.lit("0303"), random, block(F.lit(""), 1), num(0x1301), F.lit("00"), block(when(k % 3 != 0, ext(43, num(0x0304))), 2)), "02")
    sealed = lambda n: F.concat(F.lit(f"170303{n:04X}"), F.repeat(F.lit("AB"), n))
    turns = F.array(turn(True, F.substring(F.col("hello"), 1, 60)), turn(True, F.substring(F.col("hello"), 61, 100_000)), turn(False, F.col("answer")), turn(True, F.lit("140303000101")), turn(True, sealed(30)), turn(False, sealed(90)))
    c = c.select("conn", client.alias("hello"), server.alias("answer"))
    return frames_of(c.select("conn", turns.alias("turns"), F.lit("fin").alias("close")), 443)


def prs_tls(spark: SparkSession, d: str) -> DataFrame:
    """Names asked for, with what both hellos say."""
    h, a = "tls.client_hello", "tls.server_hello"
    return _parsed(_tls_frames(spark, d), "tls").select("conn", F.coalesce(f"{h}.server_name", F.lit("")).alias("sni"), F.array_join(F.transform(f"{h}.cipher_suites", lambda x: x.cast("string")), "-").alias("ciphers"), F.lower(F.hex(f"{h}.random")).alias("random"), F.array_join(F.transform(f"{h}.supported_versions", lambda x: x.cast("string")), "-").alias("versions"), F.col(f"{a}.cipher_suite").cast("bigint").alias("cipher"), F.coalesce(F.col(f"{a}.selected_version").cast("bigint"), F.lit(-1)).alias("selected"))


def fn_ja3_md5(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of both hellos, greased values left out."""
    return _parsed(_tls_frames(spark, d), "tls").select("conn", ja3_string().alias("ja3_str"), F.md5(ja3_string().cast("binary")).alias("ja3_hash"), ja3s_string().alias("ja3s_str"))


def ex_golden(spark: SparkSession, d: str) -> DataFrame:
    """Name and bytes of every TLS handshake, by subscription."""
    sub = Subscription("tls", ("TlsHandshake", "FiveTuple", "ByteCount"))
    rows = deliver(sub, _traffic(_tls_frames(spark, d), sub))
    return rows.select("FiveTuple.orig", "FiveTuple.orig_port", F.coalesce("TlsHandshake.client_hello.server_name", F.lit("")).alias("sni"), F.col("ByteCount").alias("byte_count"))


_TLS_LIST = ", ".join(f"case when c_custkey % {i + 2} <> 1 then {x} end" for i, x in enumerate(_CIPHERS))
_TLS_SQL = f"""
with c as (select c_custkey conn, case when c_custkey % 5 <> 0 then lower(replace(c_name, '#', '-') || '.' || coalesce(c_mktsegment, 'none') || '.example') else '' end sni, lower(replace(c_name, '#', '-') || '.' || coalesce(c_mktsegment, 'none') || '.example') name,
  list_filter([{_TLS_LIST}, 255], lambda x: x is not null) own, case when c_custkey % 2 = 0 then [{_GREASE}] else [] end g,
  list_filter([case when c_custkey % 5 <> 0 then 0 end, 10, 11, 43], lambda x: x is not null) exts, list_filter([29, case when c_custkey % 3 = 0 then 23 end], lambda x: x is not null) groups from customer),
j as (select *, array_to_string(g || own, '-') ciphers, '771,' || array_to_string(own, '-') || ',' || array_to_string(exts, '-') || ',' || array_to_string(groups, '-') || ',0' ja3_str from c)
"""

# SSH: the handshakes of the table

_LISTS = ("kex_algs", "server_host_key_algs", "encryption_algs_client_to_server", "encryption_algs_server_to_client", "mac_algs_client_to_server")


def _ssh_frames(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ssh_handshakes").distinct()
    clean = lambda c, instead: F.coalesce(F.regexp_replace(F.col(c), "[^!-~]", ""), F.lit(instead))

    def version(side: str) -> Column:
        v = f"{side}_version_exchange"
        return ascii_hex(F.concat(F.lit("SSH-"), F.regexp_replace(clean(f"{v}.protoversion", "2.0"), "-", ""), F.lit("-"), clean(f"{v}.softwareversion", "none"), F.coalesce(F.concat(F.lit(" "), F.col(f"{v}.comments")), F.lit("")), F.lit("\r\n")))

    cookie = F.rpad(F.substring(F.coalesce(F.hex("key_exchange.cookie"), F.lit("")), 1, 32), 32, "0")
    lists = [block(ascii_hex(F.coalesce(F.array_join(f"key_exchange.{x}", ","), F.lit(""))), 4) for x in _LISTS]
    empty = F.repeat(F.lit("00"), 4)
    kex = F.concat(F.lit("14"), cookie, *lists, empty, F.lit("000000046E6F6E65"), F.lit("000000046E6F6E65"), empty, empty, F.when(F.coalesce("key_exchange.first_kex_packet_follows", F.lit(False)), F.lit("01")).otherwise(F.lit("00")), empty)
    packet = lambda m: block(F.concat(F.lit("04"), m, empty), 4)
    t = t.select(F.col("session_id").alias("conn"), version("client").alias("c"), version("server").alias("s"), packet(kex).alias("kex"))
    keys = packet(F.lit("15"))
    turns = F.array(turn(True, F.col("c")), turn(False, F.col("s")), turn(True, F.substring(F.col("kex"), 1, 50)), turn(True, F.substring(F.col("kex"), 51, 1_000_000)), turn(True, keys), turn(False, keys))
    return frames_of(t.select("conn", turns.alias("turns"), F.lit("rst").alias("close")), 22)


def prs_ssh(spark: SparkSession, d: str) -> DataFrame:
    """Versions, cookie and lists of every handshake."""
    v = lambda side, f: F.col(f"ssh.{side}_version_exchange.{f}")
    return _parsed(_ssh_frames(spark, d), "ssh").select(
        F.col("conn").alias("session_id"), v("client", "protoversion").alias("client_proto"), v("client", "softwareversion").alias("client_software"), F.coalesce(v("client", "comments"), F.lit("-")).alias("client_comments"), v("server", "softwareversion").alias("server_software"),
        F.hex("ssh.key_exchange.cookie").alias("cookie"), *[F.array_join(f"ssh.key_exchange.{x}", ",").alias(x) for x in _LISTS], F.col("ssh.key_exchange.first_kex_packet_follows").alias("follows"), F.col("ssh.server_new_keys").alias("new_keys"),
    )


_clean_sql = lambda c, instead: f"coalesce(regexp_replace({c}, '[^!-~]', '', 'g'), '{instead}')"
_SSH_SQL = f"""
select session_id, replace({_clean_sql('client_version_exchange.protoversion', '2.0')}, '-', '') client_proto, {_clean_sql('client_version_exchange.softwareversion', 'none')} client_software, coalesce(rtrim(client_version_exchange.comments, chr(13)), '-') client_comments,
  {_clean_sql('server_version_exchange.softwareversion', 'none')} server_software, rpad(substr(coalesce(hex(key_exchange.cookie), ''), 1, 32), 32, '0') cookie, {', '.join(f"coalesce(array_to_string(key_exchange.{x}, ','), '') {x}" for x in _LISTS)},
  coalesce(key_exchange.first_kex_packet_follows, false) follows, true new_keys from (select distinct * from ssh_handshakes)
"""

# DNS: the transactions of the table

_CODES = ("NoError", "FormatError", "ServerFailure", "NameError", "NotImplemented", "Refused")


def _dns_frames(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "dns_transactions").distinct()
    name = lambda n: F.concat(F.array_join(F.transform(F.filter(F.split(n, "\\."), lambda x: x != ""), lambda x: block(ascii_hex(x), 1)), ""), F.lit("00"))
    text = lambda parts: F.array_join(parts, "")
    bit = lambda c, n: F.when(F.coalesce(F.col(c), F.lit(False)), n).otherwise(0)
    q = F.filter(F.coalesce("query.queries", F.array().cast("array<string>")), lambda n: n.isNotNull())
    ask = F.concat(hexed("transaction_id", 2), hexed(bit("query.recursion_desired", 0x100), 2), hexed(F.size(q), 2), F.lit("000000000000"), text(F.transform(q, lambda n: F.concat(name(n), F.lit("00010001")))))
    code = F.regexp_extract("response.response_code", r"Reserved\((\d+)\)", 1).cast("int")
    for i, c in enumerate(_CODES):
        code = F.when(F.col("response.response_code") == c, i).otherwise(code)
    answers = F.filter(F.coalesce("response.answers", F.expr("cast(array() as array<struct<name: string, kind: string, rdata: string, ttl: bigint>>)")), lambda a: a.isNotNull())
    kind = lambda a: F.when(a["kind"] == "A", F.lit("0001")).when(a["kind"] == "Aaaa", F.lit("001C")).otherwise(F.lit("0005"))
    rdata = lambda a: F.when(a["kind"] == "Cname", name(a["rdata"])).otherwise(F.hex(ip_bytes(a["rdata"])))
    record = lambda a: F.concat(name(a["name"]), kind(a), F.lit("0001"), hexed(F.coalesce(a["ttl"], F.lit(0)), 4), block(rdata(a), 2))
    flags = F.lit(0x8000) + bit("response.authoritative", 0x400) + bit("response.recursion_available", 0x80) + F.coalesce(code, F.lit(0))
    say = F.concat(hexed("transaction_id", 2), hexed(flags, 2), F.lit("0000"), hexed(F.size(answers), 2), F.lit("00000000"), text(F.transform(answers, record)))
    turns = F.filter(F.array(F.when(F.col("query").isNotNull(), turn(True, ask)), F.when(F.col("response").isNotNull(), turn(False, say))), lambda x: x.isNotNull())
    return frames_of(t.select(F.col("session_id").alias("conn"), turns.alias("turns"), F.lit(None).cast("string").alias("close")), 53, 17)


def prs_dns(spark: SparkSession, d: str) -> DataFrame:
    """Questions and answers of every transaction that has any. Where only the response is seen, the server opens."""
    c = _traced(_dns_frames(spark, d), "dns")
    client = F.when(F.col("orig_port") == 53, conversation_of(F.col("resp_ip"), F.col("resp_port"))).otherwise(_conn())
    s = sessions_of(c).join(c.select("conn_id", client.alias("session")), "conn_id")
    a = F.coalesce("dns.response.answers", F.expr("cast(array() as array<struct<name: string, kind: string, rdata: string, ttl: bigint>>)"))
    return s.select(
        F.col("session").alias("session_id"), F.col("dns.transaction_id").cast("bigint").alias("transaction_id"), F.coalesce(F.array_join("dns.query.queries", ","), F.lit("-")).alias("queries"), F.coalesce("dns.query.recursion_desired", F.lit(False)).alias("desired"),
        F.coalesce("dns.response.response_code", F.lit("-")).alias("response_code"), F.array_join(F.transform(a, lambda x: F.concat_ws(" ", x["name"], x["kind"], x["rdata"], x["ttl"].cast("string"))), ",").alias("answers"),
    )


_DNS_SQL = """
with t as (select distinct * from dns_transactions),
x as (select *, list_filter(coalesce(query.queries, []), lambda n: n is not null) q, list_filter(coalesce(response.answers, []), lambda a: a is not null) a from t)
select session_id, transaction_id::bigint transaction_id, case when query is null then '-' else array_to_string(list_transform(q, lambda n: regexp_replace(n, '\\.$', '')), ',') end queries, coalesce(query.recursion_desired, false) desired,
  case when response is null then '-' else coalesce(response.response_code, 'NoError') end response_code,
  array_to_string(list_transform(a, lambda r: regexp_replace(r.name, '\\.$', '') || ' ' || r.kind || ' ' || regexp_replace(r.rdata, '\\.$', '') || ' ' || coalesce(r.ttl, 0)), ',') answers
from x where len(q) > 0 or len(a) > 0
"""

# QUIC: suppliers as names asked for, their hellos sealed


def _quic_frames(spark: SparkSession, d: str) -> DataFrame:
    def sealed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = [samples.quic_initial(n, k.to_bytes(8, "big"), b"\x01\x02\x03\x04").hex() for k, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data)], ["conn", "data"])

    s = table(spark, d, "supplier").select("s_suppkey", F.lower(F.concat(F.regexp_replace("s_name", "#", "-"), F.lit(".n"), F.col("s_nationkey").cast("string"), F.lit(".example"))).alias("name"))
    turns = F.array(turn(True, F.col("data")), turn(False, F.concat(F.lit("4001020304"), F.repeat(F.lit("5A"), 40))))
    return frames_of(s.mapInArrow(sealed, "conn bigint, data string").select("conn", turns.alias("turns"), F.lit(None).cast("string").alias("close")), 443, 17)


def prs_quic(spark: SparkSession, d: str) -> DataFrame:
    """Names in the hellos of Initial packets, which are deciphered, and connection ids."""
    s = _parsed(_quic_frames(spark, d), "quic")
    return s.select("conn", "quic.tls.client_hello.server_name", F.size("quic.packets").cast("bigint").alias("n_packets"), F.array_join("quic.cids", ",").alias("cids"), F.array_join(F.get("quic.packets", F.lit(0))["frames"], ",").alias("frames"))


# Reassembly, closing, content


def ct_reassembly(spark: SparkSession, d: str) -> DataFrame:
    """Texts sent in small segments that arrive in any order, put together again by the order of the traced stream."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("conn"), F.concat_ws(" ", "c_name", "c_mktsegment", "c_acctbal", "c_name").alias("text"))
    cut = F.transform(F.sequence(F.lit(0), F.expr("(length(text) - 1) div 5")), lambda i: F.substring(F.col("text"), i * 5 + 1, F.lit(5)))
    c = c.select("conn", cut.alias("cut"), F.size(cut).alias("n"))
    mixed = F.transform("cut", lambda x, i: turn(True, ascii_hex(x), F.when(F.pmod("n", F.lit(7)) != 0, F.pmod(i * 7, F.col("n"))).otherwise(i)))
    p = decode(frames_of(c.select("conn", mixed.alias("turns"), F.lit("fin").alias("close")), 7))
    order = trace_connections(p, set(), WHOLE, columns=[*_ENDS_OF, "closed_by", "packets_orig_reassembled"]).select(_conn(), "closed_by", F.posexplode("packets_orig_reassembled").alias("at", "pkt_id"))
    # merged, as Spark expects both sides to be far smaller than they are and would broadcast one
    said = order.join(p.select("pkt_id", payload().alias("data")).hint("merge"), "pkt_id").groupBy("conn", "closed_by").agg(F.sort_array(F.collect_list(F.struct("at", F.col("data").cast("string").alias("s")))).alias("l"))
    return said.select("conn", "closed_by", F.array_join("l.s", "").alias("text"))


def _closing_frames(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    o = table(spark, d, "orders").select(k.alias("conn"), F.array(turn(True, F.repeat(F.lit("71"), (k % 50 + 1).cast("int"))), turn(False, F.repeat(F.lit("72"), (F.col("o_custkey") % 90 + 1).cast("int")))).alias("turns"), F.when(F.col("o_orderstatus") == "F", F.lit("fin")).when(F.col("o_orderstatus") == "O", F.lit("rst")).alias("close"))
    return frames_of(o, 5555)


def ct_fin_rst(spark: SparkSession, d: str) -> DataFrame:
    """Connections that end by FIN, by RST, or are open at the end."""
    return _traced(_closing_frames(spark, d), columns=("closed_by", "history", "pkt_count", "byte_count", "first_us", "last_us")).select(_conn(), "closed_by", "history", "pkt_count", "byte_count", (F.col("last_us") - F.col("first_us")).alias("duration_us"))


def agg_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks and gaps of content of which every fourth segment of ten bytes is lost."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(k.alias("conn"), F.transform(F.sequence(F.lit(0).cast("bigint"), k % 100), lambda i: turn(True, F.lit("61" * 10), None, i % 4 == 2)).alias("turns"), F.lit(None).cast("string").alias("close"))
    f = F.col("orig_flow")
    return _traced(frames_of(c, 9), columns=("orig_flow",)).select(_conn(), F.size(f["chunks"]).cast("bigint").alias("n_chunks"), f["content_gaps"].cast("bigint").alias("content_gaps"), f["missed_bytes"].cast("bigint").alias("missed_bytes"), f["max_simult_gaps"].cast("bigint").alias("max_gaps"), F.coalesce(f["mean_pkts_to_fill"], F.lit(-1.0)).alias("mean_pkts_to_fill"), F.coalesce(f["median_pkts_to_fill"], F.lit(-1)).alias("median_pkts_to_fill"))


def src_pcap(spark: SparkSession, d: str) -> DataFrame:
    """Frames written as captures by all tasks, and read back."""
    path = claim(spark, "captures")
    pcap.write(_closing_frames(spark, d), path)
    p = decode(pcap.read(spark, path))
    return p.select(F.unix_micros("ts").alias("us"), F.col("frame_len").cast("bigint").alias("frame_len"), "src_addr", F.col("src_port").cast("bigint").alias("src_port"), "seq_no", F.col("tcp_flags").cast("bigint").alias("flags"), F.col("payload_len").cast("bigint").alias("payload_len"))


QUERIES = {f.__name__: f for f in (prs_http, agg_pktframes, ex_websites, obs_tracking, stg_packet_deliver, str_session_filter, str_protocol_filter, agg_sessionlist, prs_tls, fn_ja3_md5, ex_golden, prs_ssh, prs_dns, prs_quic, ct_reassembly, ct_fin_rst, agg_chunks, src_pcap)}
_ENDS = "case when o_orderstatus = 'F' then 3 when o_orderstatus = 'O' then 1 else 0 end"
SQL = {
    "prs_http": f"""{_HTTP_SQL} select conn, depth trans_depth, case when o_orderkey % 4 = 3 then 'POST' else 'GET' end as method, '/orders/' || o_orderkey || '?p=' || substr(o_orderpriority, 1, 1) uri, 'c' || conn || '.example' host, 'probe/' || o_orderkey % 5 user_agent,
  case when o_orderkey % 4 = 3 then o_orderkey % 7 else -1 end sent, case when not answered then -1 when o_orderstatus = 'O' then 200 when o_orderstatus = 'F' then 404 else 500 end::bigint status_code,
  case when not answered then '' when o_orderstatus = 'O' then 'OK' when o_orderstatus = 'F' then 'Not Found' else 'Oh no' end status_msg, case when answered then o_orderkey % 7 else -1 end received from a""",
    "stg_packet_deliver": f"""{_HTTP_SQL}, n as (select conn, max(n) n, count(*) filter (answered) m from a group by conn), hit as (select distinct conn from a where o_orderkey % 4 = 3 and o_orderkey % 10 = 7 and o_orderpriority like '1%'),
q as (select conn, 3 + depth k, length(case when o_orderkey % 4 = 3 then 'POST' else 'GET' end || ' /orders/' || o_orderkey || '?p=' || substr(o_orderpriority, 1, 1) || ' HTTP/1.1  Host: c' || conn || '.example  User-Agent: probe/' || o_orderkey % 5 || case when o_orderkey % 4 = 3 then '  Content-Length: ' || o_orderkey % 7 || '    ' || repeat('x', o_orderkey % 7) else '    ' end) size from a),
s as (select conn, n, depth, length('HTTP/1.1 ' || case o_orderstatus when 'O' then '200 OK' when 'F' then '404 Not Found' else '500 Oh no' end || '  Content-Type: text/plain  Content-Length: ' || o_orderkey % 7 || '    ' || repeat('x', o_orderkey % 7)) size from a where answered),
f as (select * from q union all select conn, 3 + n + 2 * depth, 20 from s union all select conn, 3 + n + 2 * depth + 1, size - 20 from s union all select conn, unnest([0, 1, 2, 3 + n + 2 * m, 4 + n + 2 * m, 5 + n + 2 * m]), 0 from n)
select conn * 4096 + k pkt_id, (size + 54)::bigint frame_len from f semi join hit using (conn)""",
    "agg_pktframes": f"""{_HTTP_SQL}, n as (select conn, max(n) n, count(*) filter (answered) m from a group by conn),
t as (select conn, string_agg('HTTP/1.1 ' || case o_orderstatus when 'O' then '200 OK' when 'F' then '404 Not Found' else '500 Oh no' end || chr(13) || chr(10) || 'Content-Type: text/plain' || chr(13) || chr(10) || 'Content-Length: ' || o_orderkey % 7 || chr(13) || chr(10) || chr(13) || chr(10) || repeat('x', o_orderkey % 7), '' order by depth) text from a where answered group by conn)
select conn, 6 + n + 2 * m n, n + 4 n_orig, m n_responses, md5(coalesce(text, '')) responses from n left join t using (conn)""",
    "ex_websites": f"""{_C}, {_HTTP_SQL.strip().removeprefix('with ')}, {_TLS_SQL.strip().removeprefix('with c as').join(['tc as', '']).replace('from c)', 'from tc)')}
select protocol, website, count(*)::bigint n from (select 'dns' protocol, domain website from dq join c using (conn_id) union all select 'http', '/orders/' || o_orderkey || '?p=' || substr(o_orderpriority, 1, 1) from a
  union all select 'tls', sni from j union all select 'quic', lower(replace(s_name, '#', '-') || '.n' || s_nationkey || '.example') from supplier) where website <> '' group by all""",
    "obs_tracking": f"""with o as (select *, 5 + {_ENDS} n, 54 * (5 + {_ENDS}) + o_orderkey % 50 + 1 + o_custkey % 90 + 1 size, o_orderkey % 5 = 0 cut from orders)
select count(*) filter (not cut)::bigint tcp_new_connections, 0::bigint udp_new_connections, coalesce(sum(n - 1) filter (cut), 0)::bigint dropped_mid_tcp_pkts, coalesce(sum(size - 54) filter (cut), 0)::bigint dropped_mid_tcp_bytes from o""",
    "str_session_filter": f"""{_HTTP_SQL}, n as (select conn, max(n) n, count(*) filter (answered) m, min(depth) filter (answered and o_orderstatus = 'F') hit from a group by conn),
p as (select *, 3 + n + 2 * hit + 2 + unnest(range(0, 2 * (m - hit - 1) + 3)) pos, 5 + n + 2 * hit begin_ from n where hit is not null),
arrived as (select *, case when pos >= 3 + n and pos < 3 + n + 2 * m then 3 + n + 2 * ((pos - 3 - n) // 2) + 1 - (pos - 3 - n) % 2 else pos end k from p),
every_ as (select conn, n, m, x pos, case when x >= 3 + n and x < 3 + n + 2 * m then 3 + n + 2 * ((x - 3 - n) // 2) + 1 - (x - 3 - n) % 2 else x end k from (select *, unnest(range(0, 6 + n + 2 * m)) x from n))
select conn * 4096 + a.k pkt_id, ((a.pos - begin_) // 3 + 1)::bigint firing, (select string_agg(e.k::varchar, ',' order by e.pos) from every_ e where e.conn = a.conn and e.pos <= a.pos and (a.pos = begin_ or e.pos > a.pos - 3)) packets from arrived a where (a.pos - begin_) % 3 = 0""",
    "str_protocol_filter": f"""{_TLS_SQL}, h as (select conn, 5 + 4 + 34 + 1 + 2 + 2 * len(g || own) + 2 + 2 + case when conn % 5 <> 0 then 9 + length(name) else 0 end + 6 + 2 * (len(g) + len(groups)) + 6 + case when conn % 4 = 0 then 4 else 0 end + 9 hello, 5 + 4 + 34 + 1 + 3 + 2 + case when conn % 3 <> 0 then 6 else 0 end answer from j)
select conn * 4096 + k pkt_id, ((k + 1) * 54 + hello + case when k >= 5 then answer else 0 end + case when k >= 6 then 6 else 0 end + case when k >= 7 then 35 else 0 end + case when k >= 8 then 95 else 0 end)::bigint byte_count, (k - 3)::bigint firing, 'tls' as "FilterStr" from (select *, unnest(range(4, 12)) k from h)""",
    "agg_sessionlist": "select o_custkey conn, count(*)::bigint n_sessions from orders group by o_custkey",
    "prs_tls": f"{_TLS_SQL} select conn, sni, ciphers, md5(conn::varchar) || md5(name) random, '772-771' versions, 4865::bigint cipher, case when conn % 3 <> 0 then 772 else -1 end::bigint selected from j",
    "fn_ja3_md5": f"{_TLS_SQL} select conn, ja3_str, md5(ja3_str) ja3_hash, '771,4865,' || case when conn % 3 <> 0 then '43' else '' end ja3s_str from j",
    "ex_golden": f"""{_TLS_SQL} select concat_ws('.', 10, (conn >> 16) & 255, (conn >> 8) & 255, conn & 255) orig, (20000 + (conn >> 24))::int orig_port, sni,
  (12 * 54 + (5 + 4 + 34 + 1 + 2 + 2 * len(g || own) + 2 + 2 + case when conn % 5 <> 0 then 9 + length(name) else 0 end + 6 + 2 * (len(g) + len(groups)) + 6 + case when conn % 4 = 0 then 4 else 0 end + 9)
    + (5 + 4 + 34 + 1 + 3 + 2 + case when conn % 3 <> 0 then 6 else 0 end) + 6 + 35 + 95)::bigint byte_count from j""",
    "prs_ssh": _SSH_SQL,
    "prs_dns": _DNS_SQL,
    "prs_quic": "select s_suppkey conn, lower(replace(s_name, '#', '-') || '.n' || s_nationkey || '.example') server_name, 2::bigint n_packets, array_to_string(list_sort(['01020304', printf('%016x', s_suppkey)]), ',') cids, 'Crypto,Padding' frames from supplier",
    "ct_reassembly": "select c_custkey conn, 'fin' closed_by, concat_ws(' ', c_name, c_mktsegment, c_acctbal::varchar, c_name) as text from customer",
    "ct_fin_rst": f"""select o_orderkey conn, case o_orderstatus when 'F' then 'fin' when 'O' then 'rst' else 'end' end closed_by, 'ShADd' || case o_orderstatus when 'F' then 'Ff' when 'O' then 'R' else '' end history, (5 + {_ENDS})::bigint pkt_count,
  (54 * (5 + {_ENDS}) + o_orderkey % 50 + 1 + o_custkey % 90 + 1)::bigint byte_count, (1000 * (4 + {_ENDS}))::bigint duration_us from orders""",
    "agg_chunks": """with c as (select c_custkey conn, c_custkey % 100 + 1 n from customer), s as (select conn, i, i % 4 = 2 lost, sum(case when i % 4 = 2 then 0 else 1 end) over (partition by conn order by i) arrived from (select conn, unnest(range(0, n)) i from c)),
k as (select conn, max(arrived) total, max(i) filter (not lost) last from s group by conn), g as (select s.conn, total - s.arrived n from s join k using (conn) where lost and i < last)
select k.conn, (count(g.n) + 1)::bigint n_chunks, count(g.n)::bigint content_gaps, (10 * count(g.n))::bigint missed_bytes, count(g.n)::bigint max_gaps, coalesce(avg(g.n), -1)::double mean_pkts_to_fill,
  coalesce(list_sort(list(g.n) filter (g.n is not null))[count(g.n) // 2 + 1], -1)::bigint median_pkts_to_fill from k left join g using (conn) group by k.conn""",
    "src_pcap": f"""with o as (select *, o_orderkey conn, o_orderkey % 50 + 1 up, o_custkey % 90 + 1 down, (o_orderkey * 2654435761) % 4294967296 a, (o_orderkey * 40503 + 77777) % 4294967296 b from orders),
p as (select *, unnest(range(0, 5 + {_ENDS})) k from o)
select 1700000000000000 + conn * 20000 + k * 1000 us, (54 + case k when 3 then up when 4 then down else 0 end)::bigint frame_len, case when k in (1, 4, 6) then 3323068417 else 167772160 + conn % 16777216 end::bigint src_addr, case when k in (1, 4, 6) then 5555 else 20000 + (conn >> 24) end::bigint src_port,
  (case k when 0 then a when 1 then b when 2 then a + 1 when 3 then a + 1 when 4 then b + 1 when 5 then a + 1 + up when 6 then b + 1 + down else a + 2 + up end % 4294967296)::bigint seq_no,
  case k when 0 then 2 when 1 then 18 when 2 then 16 when 3 then 24 when 4 then 24 when 5 then case when o_orderstatus = 'F' then 17 else 4 end when 6 then 17 else 16 end::bigint flags, case k when 3 then up when 4 then down else 0 end::bigint payload_len from p""",
}
