"""Subscriptions, configuration, streaming, and queries against SQL."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from packetloom.observe import counted, rates
from packetloom.operators.conntrack import Timeouts, connections
from packetloom.plans.subscribe import DATATYPES, Level, Subscription, SubscriptionError, deliver, deliver_all, load_subscriptions
from packetloom.queries import activity, captures, fields, flows, headers, protocols, services
from packetloom.functions.headers import decode
from packetloom.sources import pcap, samples, sinks
from packetloom.sources.adapters import packets_from_events
from packetloom.sources.config import load_config, load_packets
from packetloom.sources.traffic import Traffic, traffic_from_frames
from packetloom.streaming.connections import stream_connections
from packetloom.streaming.triggers import Trigger, batch_triggers, deliver_firings, stream_triggers
from tests.compare import rows_of, rows_of_sql
from tests.conftest import DATA


def test_levels():
    assert len(DATATYPES) == 29
    assert Subscription("tls", ("FiveTuple", "TlsHandshake")).level == Level.SESSION
    assert Subscription("tls", ("FiveTuple", "TlsHandshake", "ConnRecord")).level == Level.CONNECTION
    assert Subscription("tcp", ("FiveTuple",)).level == Level.STATIC
    assert Subscription("tcp.syn = 1", ("ZcFrame", "CoreId")).level == Level.PACKET
    assert Subscription("dns or tls.sni = 'x'", ("DnsTransaction",)).protocols == {"dns", "tls"}


@pytest.mark.parametrize(("text", "wanted", "streaming"), [("tcp", ("ZcFrame", "Payload"), None), ("tcp", ("ZcFrame", "ConnRecord"), None), ("tls", ("TlsHandshake", "HttpTransaction"), None), ("tcp", ("Nonsense",), None), ("tcp", (), None), ("tcp", ("FiveTuple",), ("packets", 3)), ("tcp", ("PktCount",), ("hours", 3))])
def test_bad_subscriptions(text, wanted, streaming):
    with pytest.raises(SubscriptionError):
        Subscription(text, wanted, streaming=streaming)


@pytest.fixture(scope="module")
def traffic(spark):
    conns = spark.createDataFrame([("c1", 4, 6, "10.0.0.1", 1, 167772161, "1.1.1.1", 443, 16843009, "tls", 5, 500), ("c2", 4, 17, "10.0.0.2", 2, 167772162, "1.1.1.1", 53, 16843009, "dns", 2, 90), ("c3", 4, 6, "10.0.0.1", 3, 167772161, "1.1.1.2", 80, 16843010, None, 1, 60)], "conn_id string, ip_version int, proto int, orig string, orig_port int, orig_addr bigint, resp string, resp_port int, resp_addr bigint, service string, pkt_count int, byte_count int")
    dns = "struct<query: struct<queries: array<string>>>"
    sessions = spark.createDataFrame([("c2", 1, "dns", ((["a.com"],),)), ("c2", 2, "dns", ((["b.net"],),)), ("c2", 3, "dns", (None,))], f"conn_id string, session_id int, protocol string, dns {dns}")
    packets = spark.createDataFrame([(i, c, 4, p) for i, (c, p) in enumerate([("c1", 6), ("c1", 6), ("c2", 17), ("c3", 6)])], "pkt_id int, conn_id string, ip_version int, proto int").withColumn("frame", F.lit(b"x"))
    return Traffic(packets, conns, sessions)


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_delivery(traffic):
    assert ids(deliver(Subscription("tcp", ("ZcFrame", "FilterStr")), traffic), "pkt_id") == [(0,), (1,), (3,)]
    assert ids(deliver(Subscription("dns.query_domain ~ 'net$'", ("ZcFrame",)), traffic), "pkt_id") == [(2,)]  # all packets of the connection
    assert ids(deliver(Subscription("dns.query_domain != 'a.com'", ("DnsTransaction",)), traffic), "session_id") == [(2,), (3,)]  # a missing value differs from any text
    assert ids(deliver(Subscription("tls", ("PktCount", "FiveTuple")), traffic), "conn_id", "PktCount") == [("c1", 5)]
    first = deliver(Subscription("dns.query_domain = 'b.net'", ("DnsTransaction", "ByteCount")), traffic).collect()
    assert len(first) == 1 and first[0].DnsTransaction.query.queries == ["a.com"]  # the first session, not the one that matched
    assert len(deliver(Subscription("udp", ("SessionList",)), traffic).first().SessionList) == 3
    assert ids(deliver(Subscription("ipv4.src_addr = 10.0.0.1", ("FiveTuple",)), traffic), "conn_id") == [("c1",), ("c3",)]


def test_capture_delivery(spark, tmp_path):
    pcap.write_pcap(str(tmp_path / "a.pcap"), samples.sample_capture())
    t = traffic_from_frames(decode(pcap.read(spark, str(tmp_path)), names=["eth_src", "eth_dst"]), {"tls", "dns", "ssh"})
    tls = deliver(Subscription("tls.sni = 'shop.example'", ("ZcFrame", "FilterStr")), t)
    assert tls.count() == 12  # all packets from the first on
    assert deliver(Subscription("tcp.syn = 1 and tcp.ack = 0", ("Payload",)), t).count() == 4
    rows = deliver(Subscription("ipv6 and tls", ("TlsHandshake", "FiveTuple", "ConnRecord", "InterArrivals", "BidirPktStream", "OrigPktsReassembled", "EthAddr", "EtherTCI")), t).collect()
    assert len(rows) == 1 and rows[0].FiveTuple.orig == "2001:db8::2" and len(rows[0].BidirPktStream) == 12 and len(rows[0].OrigPktsReassembled) == 8
    assert deliver(Subscription("ssh.key_exchange_cookie_stoc contains |15 1A|", ("SshHandshake",)), t).count() == 1
    assert {len(x.SessionList) for x in deliver(Subscription("dns", ("SessionList",)), t).collect()} == {3}


def test_sinks(spark, tmp_path, traffic):
    rows = deliver(Subscription("", ("ConnRecord",)), Traffic(None, traffic.connections.withColumns({"first_us": F.lit(0), "last_us": F.lit(1), "duration_us": F.lit(1), "history": F.lit("S")}), traffic.sessions))
    sinks.write_json(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3 and len(list(sinks.pretty_json(rows))) == 3
    counts = traffic.connections.groupBy("service").count().withColumnRenamed("count", "n")
    assert list(sinks.exposition(counts, "seen", ["service"])) == ["# TYPE seen counter", 'seen{service="None"} 1', 'seen{service="dns"} 1', 'seen{service="tls"} 1']
    odd = spark.createDataFrame([('a"b\\c\nd', i) for i in (7,)], "x string, n int")
    assert list(sinks.exposition(odd, "y", ["x"]))[1] == 'y{x="a\\"b\\\\c\\nd"} 7'
    assert sum(1 for _ in sinks.pretty_json(spark.range(1500))) == 1500
    sinks.write_log(counts, str(tmp_path / "log"))
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 3
    sinks.for_each(rows, lambda r: None)
    fired = deliver_firings(Subscription("tcp", ("PktCount",), streaming=("packets", 4)), packets_from_events(spark, DATA))
    assert fired.where("PktCount < 1").count() == 0


def test_same_callback_once(traffic):
    subs = [Subscription(f, ("DnsTransaction",), "cb") for f in ("dns", "dns and udp", "dns.query_domain contains 'a'")]
    assert deliver_all(subs, traffic)["cb"].count() == 3
    named = [Subscription(s.filter, ("DnsTransaction", "FilterStr"), "cb") for s in subs]
    assert deliver_all(named, traffic)["cb"].count() == 7


def test_files(tmp_path):
    (tmp_path / "s.toml").write_text('[[subscriptions]]\nfilter = "tls.sni ~ \'x$\'"\ndatatypes = ["TlsHandshake", "FilterStr"]\ncallback = "a"\n[[subscriptions]]\nfilter = ""\ndatatypes = "PktCount"\ncallback = "b"\nstreaming = { Packets = 3 }\n')
    a, b = load_subscriptions(str(tmp_path / "s.toml"))
    assert a.datatypes == ("TlsHandshake", "FilterStr") and b.streaming == ("packets", 3)
    (tmp_path / "c.toml").write_text('[offline]\npcap = "x.pcap"\nmtu = 1500\n[conntrack]\nudp_inactivity_timeout = 1000\n')
    c = load_config(str(tmp_path / "c.toml"))
    assert c.timeouts.udp == 1_000_000 and c.timeouts.offline and c.offline.mtu == 1500
    (tmp_path / "d.toml").write_text("[conntrack]\n")
    with pytest.raises(ValueError):
        load_config(str(tmp_path / "d.toml"))


def fire(unit, n, packets, until=None):
    t = Trigger(unit, n, Timeouts(), until)
    return [i for i, (us, size) in enumerate(packets) if t.packet(us, size, False)]


def test_trigger_rules():
    ps = [(i * 1_000_000, 100) for i in range(10)]
    assert fire("packets", 3, ps) == [0, 3, 6, 9]
    assert fire("bytes", 250, ps) == [0, 3, 6, 9]  # what is over doesn't count for the next time
    assert fire("seconds", 4, ps) == [0, 4, 8]
    assert fire("packets", 2, ps, lambda n, size: n >= 5) == [0, 2, 4]
    assert fire("packets", 3, [(0, 1), (1, 1), (10**9, 1)]) == [0, 2]  # a new connection after the idle time


def run_stream(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


def test_stream_equals_batch(spark, tmp_path):
    p = packets_from_events(spark, DATA).where("proto = 6").orderBy("ts")
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    long = Timeouts(tcp=10**15, udp=10**15)
    got = run_stream(stream_triggers(stream, "packets", 5, long), "fired").select("pkt_id", "pkt_count").collect()
    want = batch_triggers(p, "packets", 5, long).select("pkt_id", "pkt_count").collect()
    assert sorted(got) == sorted(want) and want
    # what the watermark has passed is delivered as tables have it
    short = Timeouts(tcp=60_000_000)
    conns = run_stream(stream_connections(stream, short, "1 second"), "conns")
    cols = ["first_us", "last_us", "orig_port", "pkt_count", "byte_count", "history", "orig_n_payload", "resp_n_pkts"]
    got, whole = {tuple(x) for x in conns.select(*cols).collect()}, {tuple(x) for x in connections(p, short).select(*cols).collect()}
    assert len(got) > 20 and got <= whole


def test_capture_stream(spark, tmp_path):
    for i in range(3):
        pcap.write_pcap(str(tmp_path / f"{i}.pcap"), samples.sample_capture())
    pcap.register(spark)
    df = spark.readStream.format("pcap").option("files_per_batch", 2).load(str(tmp_path))
    assert run_stream(df, "frames").count() == 3 * len(samples.sample_capture())
    (tmp_path / "c.toml").write_text(f'[online]\nports = [{{ folder = "{tmp_path}" }}]\nnb_buckets = 256\n')
    assert load_packets(spark, load_config(str(tmp_path / "c.toml"))).isStreaming


def test_report():
    from packetloom.observe import report

    text = report([Subscription("tls.sni ~ 'x$' and tcp.port = 443", ("TlsHandshake",), "cb"), Subscription("", ("PktCount",), streaming=("packets", 3))])
    assert "decided by: session; delivered by: session; parsers: tls" in text and "tls.sni ~ 'x$'" in text and "every 3 packets" in text


def test_counters(spark):
    p = packets_from_events(spark, DATA)
    from packetloom.filterlang import Filter

    df, seen = counted(p, Filter("tcp"))
    n = df.count()
    c = seen.get
    assert c["total_pkts"] == n and c["tcp_pkts"] + c["udp_pkts"] == n and c["ignored_pkts"] == c["udp_pkts"]
    assert rates({"total_pkts": 10, "total_bytes": 1000}, 2)["ingress_bps"] == (1000 + 200) * 8 / 2


SOME = ["p4_found", "p4_sessions", "p5_found", "p5_addresses", "p5_first_hour", "op_in_cidr6", "flt_precedence", "jn_cidr_range", "jn_rules_packets", "ct_timeout_tcp", "agg_connrecord", "agg_content_gaps", "agg_interarrivals", "agg_gap_figures", "agg_pktlists", "jn_conn_packets", "str_packets_n", "str_bytes_n", "str_seconds_s", "str_unsubscribe", "stg_conn_deliver", "op_bre", "ex_basic", "ex_protocols", "jn_dns_txid", "ct_decode", "obs_counters", *protocols.QUERIES, *fields.QUERIES]


@pytest.mark.parametrize("name", SOME)
def test_queries(spark, duck, name):
    assert rows_of(entry.queries()[name](spark, DATA)) == rows_of_sql(duck, entry.oracle_sql()[name])


def test_registry():
    core = [activity, headers, flows, services, captures, protocols, fields]
    names = [n for m in core for n in m.QUERIES]
    assert len(names) == len(set(names)) and all(s in names for m in core for s in m.SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark):
    from packetloom.observe import plan

    text = plan(entry.queries()["op_eq"](spark, DATA))
    assert "PushedFilters" in text and "EqualTo(dst_port,443)" in text and "cookie" not in text
