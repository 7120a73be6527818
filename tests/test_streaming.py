"""Streaming subscriptions: filters of every stage over tables and streams, clearing, and filters on Python values."""

import json

import pytest
from pyspark.sql import functions as F

from packetloom.filterlang import Filter, holds
from packetloom.filterlang.interpret import matches, on_connection
from packetloom.functions.headers import decode
from packetloom.operators.conntrack import Timeouts
from packetloom.operators.trace import trace_connections
from packetloom.plans.subscribe import Subscription, SubscriptionError, deliver
from packetloom.sources import pcap, samples
from packetloom.sources.traffic import Traffic, traffic_from_frames
from packetloom.streaming.subscribed import deliver_stream, firings
from packetloom.streaming.triggers import deliver_firings
from tests.test_delivery import run_stream

LONG = Timeouts(tcp=10**12, udp=10**12, establish=10**12)
SUBS = [
    Subscription("tls", ("PktCount", "FiveTuple"), streaming=("packets", 1)), Subscription("tls.sni = 'shop.example'", ("ByteCount", "TlsHandshake"), streaming=("bytes", 60)), Subscription("http.status_code = 404", ("ConnRecord", "FilterStr"), streaming=("packets", 1)),
    Subscription("tcp.port = 22", ("OrigPktsReassembled",), streaming=("packets", 2)), Subscription("ssh", ("ConnHistory",), streaming=("seconds", 0.002)), Subscription("dns.query_domain ~ 'test$'", ("InterArrivals",), streaming=("packets", 1)), Subscription("udp", ("ConnDuration",), streaming=("packets", 2)),
]


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pcap")
    pcap.write_pcap(str(d / "a.pcap"), [(us + 10**15, f) for us, f in samples.sample_capture()])
    return decode(pcap.read(spark, str(d))), str(d)


def plain(df):
    return sorted(json.dumps(json.loads(x), sort_keys=True) for x in df.toJSON().collect())


@pytest.mark.parametrize("k", range(len(SUBS)))
def test_stream_of_subscription_equals_table(spark, frames, k, tmp_path):
    table, folder = frames
    want = plain(firings(SUBS[k], table, LONG))
    pcap.register(spark)
    stream = decode(spark.readStream.format("pcap").load(folder))
    assert plain(run_stream(firings(SUBS[k], stream, LONG), f"subscribed{k}")) == want and want


DONE = [Subscription("tls", ("TlsHandshake", "FiveTuple")), Subscription("http.status_code >= 404", ("HttpTransaction",)), Subscription("dns.query_domain ~ 'test$'", ("DnsTransaction", "FilterStr")), Subscription("ssh.comments_ctos contains 'first'", ("ConnRecord",)), Subscription("tcp", ("PktCount", "FiveTuple")), Subscription("tls.sni = 'shop.example'", ("TlsHandshake", "ByteCount")), Subscription("udp and dns", ("ConnHistory",))]


@pytest.mark.parametrize("k", range(len(DONE)))
def test_delivery_over_a_stream(spark, frames, k, tmp_path):
    """Sessions and connections of a stream are those of the table; a packet from much later lets the watermark pass them."""
    table, folder = frames
    sub = DONE[k]
    want = plain(deliver(sub, traffic_from_frames(table, sub.protocols, Timeouts())))
    later = [[(10**15 + 10**12 * (i + 1), f) for f in (samples.tcp("10.9.9.9", 9, "10.9.9.8", 9, 16, 5, 5, b""), samples.udp("10.9.9.9", 9, "10.9.9.8", 9, b""))] for i in range(2)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pcap").write_bytes(open(f"{folder}/a.pcap", "rb").read())
    for i, x in enumerate(later):
        pcap.write_pcap(str(tmp_path / "in" / f"b{i}.pcap"), x)
    pcap.register(spark)
    stream = decode(spark.readStream.format("pcap").option("files_per_batch", 1).load(str(tmp_path / "in")))
    assert plain(run_stream(deliver_stream(sub, stream, Timeouts(), "1 second"), f"delivered{k}")) == want and want


def test_packets_over_a_stream(spark, frames):
    table, folder = frames
    pcap.register(spark)
    stream = decode(spark.readStream.format("pcap").load(folder))
    sub = Subscription("tcp.syn = 1", ("ZcFrame",))
    assert run_stream(deliver_stream(sub, stream), "syns").count() == deliver(sub, Traffic(table, None, None)).count() > 0
    with pytest.raises(SubscriptionError):
        deliver_stream(Subscription("tls", ("ZcFrame",)), stream)


def test_firings(spark, frames):
    table, _ = frames
    tls = firings(SUBS[0], table, LONG).where("FiveTuple.orig = '10.0.0.2'").orderBy("us").collect()
    assert [x.PktCount for x in tls] == list(range(5, 13)) and [x.firing for x in tls] == list(range(1, 9))  # from the packet after the first bytes on
    record = firings(SUBS[2], table, LONG).orderBy("us").collect()
    assert [x.ConnRecord.history for x in record] == ["ShADdF", "f", "A"] and record[-1].ConnRecord.pkt_count == 10  # history is cleared, counters go on
    lists = firings(SUBS[3], table, LONG).orderBy("us").collect()
    ids = [i for x in lists for i in x.OrigPktsReassembled]
    assert len(ids) == len(set(ids)) and len(lists) > 2  # no packet twice
    some = firings(SUBS[0], table, LONG, until=lambda pkts, size: pkts >= 6).where("FiveTuple.orig = '10.0.0.2'")
    assert [x.PktCount for x in some.orderBy("us").collect()] == [5, 6]
    assert firings(SUBS[0], table.limit(0), LONG).count() == 0


def test_what_cannot_be_streamed(frames):
    table, _ = frames
    with pytest.raises(SubscriptionError):
        firings(Subscription("tcp", ("PktCount", "EthAddr"), streaming=("packets", 1)), table)
    with pytest.raises(SubscriptionError):
        firings(Subscription("tcp", ("PktCount",)), table)
    with pytest.raises(SubscriptionError):
        deliver_firings(Subscription("tcp", ("ConnRecord",), streaming=("packets", 1)), table)


FILTERS = [
    "tls.sni ~ 'shop\\.example$'", "tls.version = 772", "tls.cipher != 4865", "tls.ja3_str contains '4865'", "tls.ja3_hash = '0'", "tls.ja3s_str ~ '^771'", "tls.client_random contains |01 02|", "http.uri = '/b' or http.status_code >= 500", "http.host contains 'shop' and tcp.dst_port = 80",
    "dns.query_domain ~ '^[ab]'", "dns.response contains 'NoError'", "dns.answers ~ '198\\.18'", "dns.nameservers = 'x'", "dns.query_domain != 'a.example' and ipv4.src_addr in 10.0.0.0/8", "ssh.comments_ctos contains 'first'", "ssh.key_exchange_cookie_stoc ~b '\\x15\\x1a$'", "ssh.protocol_version_stoc = |32 2E 30|", "ssh.software_version_ctos eq 'client_1.0'", "ipv6 and tls", "quic", "tcp.port in 1..1000 and ssh", "udp.port != 53 and dns", "ipv6.addr in 2001:db8::/32 and tls.sni != 'x'", "ipv4.addr = 10.0.0.3 and ssh",
]


def test_interpreter_equals_columns(spark, frames):
    """Filters on Python values let through the same sessions as their columns."""
    t = traffic_from_frames(frames[0], {"tls", "http", "dns", "ssh", "quic"}, Timeouts(offline=True))
    ends = [c for c in t.connections.columns if c not in t.sessions.columns or c == "conn_id"]
    rows = t.sessions.join(t.connections.select(*ends), "conn_id")
    traced = trace_connections(frames[0], timeouts=Timeouts(offline=True)).collect()
    hits = 0
    for text in FILTERS:
        f = Filter(text)
        want = {(x.conn_id, x.session_id) for x in rows.where(holds(f.on_sessions())).select("conn_id", "session_id").collect()}
        got = set()
        for c in traced:
            ends = {k: c[k] for k in ("ip_version", "proto", "orig_port", "resp_port")} | {"orig_ip": bytes(c.orig_ip), "resp_ip": bytes(c.resp_ip)}
            for s in c.sessions:
                session = s[s.protocol].asDict(recursive=True)
                if matches(f.tree, on_connection(ends, s.protocol, session)):
                    got.add((c.conn_id, s.session_no))
        assert got == want, text
        hits += bool(want)
    assert hits > 14
