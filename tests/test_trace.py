"""Captures written byte by byte, reassembly, content, closing, parsers, features against a naive tracker."""

import random
import struct
from collections import defaultdict

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from packetloom.functions.fingerprints import ja3_string
from packetloom.functions.headers import decode
from packetloom.operators import conntrack as C
from packetloom.operators.reassembly import ACK, FIN, SYN, Content, Stream, TooFarOutOfOrder
from packetloom.operators.trace import fold, sessions_of, trace_connections
from packetloom.parsers.aes import encrypt_block
from packetloom.parsers.quic import initial_keys
from packetloom.sources import pcap, samples


@pytest.mark.parametrize(
    ("chunks", "new", "want"),
    [
        ([(10, 20)], (0, 5), [(0, 5), (10, 20)]), ([(10, 20)], (25, 30), [(10, 20), (25, 30)]), ([(0, 5), (10, 20)], (5, 10), [(0, 20)]),
        ([(10, 20)], (15, 30), [(10, 30)]), ([(0, 5), (20, 30)], (8, 12), [(0, 5), (8, 12), (20, 30)]), ([(0, 5), (8, 12), (20, 30)], (3, 25), [(0, 30)]), ([(0, 5)], (7, 7), [(0, 5)]),
    ],
)
def test_content(chunks, new, want):
    c = Content(chunks=list(chunks))
    c.insert(*new)
    assert c.chunks == want
    assert c.missed_bytes == sum(b[0] - a[1] for a, b in zip(want, want[1:], strict=False))


def test_gaps_to_fill():
    c = Content()
    assert c.mean_pkts_to_fill is None and c.median_pkts_to_fill is None
    for s in (0, 20, 30, 10):
        c.insert(s, s + 10)
    assert c.chunks == [(0, 40)] and c.most_gaps == 1 and c.gaps == {10: 2} and c.median_pkts_to_fill == 2


def test_many_chunks():
    """More chunks than a hundred, in any order, against arrivals counted one by one."""
    r = random.Random(3)
    spans = [(20 * i, 20 * i + 10) for i in range(400)] + [(20 * i + 10, 20 * i + 20) for i in range(0, 400, 3)]
    r.shuffle(spans)
    c, seen, gaps = Content(), set(), defaultdict(int)
    for a, b in spans:
        c.insert(a, b)
        seen |= set(range(a, b))
        ends = sorted(x + 1 for x in seen if x + 1 not in seen)
        for e in ends[:-1]:
            gaps[e] += 1
    assert len(c.chunks) == len(ends) > 200 and c.gaps == gaps and c.ignored == 0
    small = Content(capacity=2)
    for s in (0, 20, 40):
        small.insert(s, s + 10)
    assert small.ignored == 1 and len(small.chunks) == 2


@pytest.mark.parametrize("isn", [1000, (1 << 32) - 7])
@pytest.mark.parametrize("seed", range(5))
def test_stream_in_any_order(isn, seed):
    text = bytes(random.Random(seed).randrange(256) for _ in range(400))
    parts = [(i, min(i + 23, 400)) for i in range(0, 400, 17)]  # they overlap
    random.Random(seed).shuffle(parts)
    s = Stream()
    assert s.push(0, isn, 0, SYN, b"") == [(0, b"")]
    out = b"".join(d for n, (a, b) in enumerate(parts) for _, d in s.push(n, (isn + 1 + a) % (1 << 32), 0, ACK, text[a:b]))
    assert out == text and not s.waiting
    s.push(99, (isn + 401) % (1 << 32), 0, FIN | ACK, b"end")
    assert s.fin and s.next_seq == (isn + 405) % (1 << 32)  # a FIN comes after its payload


def test_stream_begins_late():
    s = Stream()
    assert s.push(1, 11, 0, 8, b"def") == [] and s.push(2, 8, 0, 8, b"abc") == []  # no SYN or ACK yet: they wait
    assert s.push(3, 7, 0, SYN, b"") == [(3, b""), (2, b"abc"), (1, b"def")]


def test_stream_overflow():
    s = Stream(most=2)
    s.push(0, 0, 0, SYN, b"")
    s.push(1, 100, 0, ACK, b"x")
    s.push(2, 200, 0, ACK, b"x")
    with pytest.raises(TooFarOutOfOrder):
        s.push(3, 300, 0, ACK, b"x")


def test_crypto_vectors():
    """From the public standards: one block of FIPS 197, and the initial keys and mask of RFC 9001, appendix A."""
    assert encrypt_block(bytes(range(16)), bytes.fromhex("00112233445566778899aabbccddeeff")).hex() == "69c4e0d86a7b0430d8cdb78070b4c55a"
    key, iv, hp = initial_keys(1, bytes.fromhex("8394c8f03e515708"), True)
    assert (key.hex(), iv.hex(), hp.hex()) == ("1f369613dd76d5467730efcbe3b1a22d", "fa044b2f42a3fd3b46fb255c", "9f50449e04a0e810283a1e9933adedd2")
    assert encrypt_block(hp, bytes.fromhex("d1b1c98dd7689fb8ec11d242b123dc9b"))[:5].hex() == "437b9aec36"


@pytest.fixture(scope="module")
def frames(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("pcap")
    pcap.write_pcap(str(d / "a.pcap"), samples.sample_capture())
    pcap.write_pcap(str(d / "b.pcap"), samples.quic_capture())
    return decode(pcap.read(spark, str(d))).cache()


def test_capture(spark, frames, tmp_path):
    assert frames.count() == len(samples.sample_capture()) + 2
    assert frames.where("proto is null").count() == 1
    assert {x.vlan_tci for x in frames.select("vlan_tci").distinct().collect()} == {None, 12}
    assert frames.where("ip_version = 6").select(F.hex("src_ip")).first()[0].startswith("20010DB8")
    pcap.write_pcap(str(tmp_path / "x.pcap"), [(0, b"\0" * 3000), (1, b"\0" * 60)])
    assert pcap.read(spark, str(tmp_path / "x.pcap"), mtu=1500).count() == 1
    (tmp_path / "cut.pcap").write_bytes((tmp_path / "x.pcap").read_bytes()[:-10])
    assert pcap.read(spark, str(tmp_path / "cut.pcap")).count() == 1


def test_capture_splits(spark, tmp_path):
    r = random.Random(4)
    frames = [(i * 1000, r.randbytes(r.choice([60, 1500, 9000]))) for i in range(3000)]
    pcap.write_pcap(str(tmp_path / "x.pcap"), frames)
    df = pcap.read(spark, str(tmp_path / "x.pcap"), split_bytes=1 << 20)
    assert df.rdd.getNumPartitions() > 5
    got = sorted((x.us, bytes(x.frame)) for x in df.select(F.unix_micros("ts").alias("us"), "frame").collect())
    assert got == frames and df.select("pkt_id").distinct().count() == len(frames)
    inner = b"".join(struct.pack("<IIII", 5, 5, 44, 44) + bytes(44) for _ in range(100))  # records inside a frame
    pcap.write_pcap(str(tmp_path / "y.pcap"), [(i, inner) for i in range(200)])
    for size in (700_000, 900_001):
        try:
            n = pcap.read(spark, str(tmp_path / "y.pcap"), split_bytes=size).count()
        except Exception as e:
            assert "can't be split" in str(e)
        else:
            assert n == 200
    assert pcap.read(spark, f"file://{tmp_path}/y.pcap", split_bytes=0).count() == 200
    assert pcap.read(spark, f"{tmp_path}/*.pcap", split_bytes=0).count() == 3200


def test_capture_sink(spark, tmp_path):
    rows = spark.createDataFrame([(i, samples.udp("10.0.0.1", 1, "10.0.0.2", 2, bytes([i]))) for i in range(50)] + [(99, None)], "us bigint, frame binary").withColumn("ts", F.timestamp_micros("us")).withColumn("pkt_id", F.lit(0))
    for mode in ("append", "append", "overwrite"):
        pcap.write(rows.repartition(3), str(tmp_path / "out"), mode)
    got = pcap.read(spark, str(tmp_path / "out"))
    assert sorted(bytes(x.frame) for x in got.collect()) == sorted(bytes(x.frame) for x in rows.where("frame is not null").collect())
    seen = Observation("skipped")
    kept = pcap.read(spark, str(tmp_path / "out"), mtu=42, seen=seen)
    assert kept.count() == 0 and seen.get == {"oversize_pkts": 50, "oversize_bytes": 50 * 43}


def test_malformed(spark):
    good = samples.udp("10.0.0.1", 1, "10.0.0.2", 2, b"abc")
    bad = [None, b"", good[:20], samples.udp("10.0.0.1", 1, "10.0.0.2", 2, b"abc", length=10), good[:12] + b"\x81\x00\x00\x01\x81\x00\x00\x02" + good[12:]]
    got = decode(spark.createDataFrame([(i, f) for i, f in enumerate([good, *bad])], "pkt_id int, frame binary")).orderBy("pkt_id").collect()
    assert (got[0].proto, got[0].src_port, got[0].payload_len, got[0].udp_length) == (17, 1, 3, 11)
    assert all(r.proto is None and r.src_port is None for r in got[1:])


def test_own_header(spark):
    from packetloom.functions import headers

    headers.register_header("mine", lambda f, at: {"kind": headers.number(f, at, 1), "size": headers.number(f, at + 1, 2)})
    try:
        rows = [(1, samples.udp("10.0.0.1", 1, "10.0.0.2", 2, b"\x07\x01\x00x")), (2, samples.udp("10.0.0.1", 1, "10.0.0.2", 2, b"")), (3, None)]
        got = decode(spark.createDataFrame(rows, "pkt_id int, frame binary"), names=["mine_kind", "mine_size"]).orderBy("pkt_id").collect()
        assert [(x.mine_kind, x.mine_size) for x in got] == [(7, 256), (None, None), (None, None)]
    finally:
        del headers.REGISTERED["mine"]


def test_sessions_of_captures(frames):
    c = trace_connections(frames).cache()
    by = {(x.orig_port, x.service): x for x in c.collect()}
    assert by[40001, "http"].history == "ShADdFf" and by[40001, "http"].closed_by == "fin"
    assert c.where("orig_port = 1 or resp_port = 1").count() == 0  # the middle of a connection is none
    s = sessions_of(c).cache()
    http = sorted((x.n, x.uri, x.status_code) for x in s.where("protocol = 'http'").select(F.col("http.trans_depth").alias("n"), "http.request.uri", "http.response.status_code").collect())
    assert http == [(0, "/a", 200), (1, "/b", 404), (2, "/c", 500)]
    dns = {(x.q, x.c) for x in s.where("protocol = 'dns'").select(F.get("dns.query.queries", F.lit(0)).alias("q"), F.col("dns.response.response_code").alias("c")).collect()}
    assert dns == {("a.example", "NoError"), ("b.test", "NoError"), ("unanswered.example", None)}
    ssh = s.where("protocol = 'ssh'").select("ssh.client_version_exchange", "ssh.key_exchange.cookie", "ssh.server_dh", "ssh.server_new_keys").first()
    assert ssh.client_version_exchange.comments == "first try" and bytes(ssh.cookie)[-2:] == b"\x15\x1a" and ssh.server_new_keys and bytes(ssh.server_dh.f) == b"f"
    tls = s.where("protocol = 'tls'").select("tls.client_hello.server_name", ja3_string().alias("ja3"), "tls.server_hello.selected_version").collect()
    assert {x.server_name for x in tls} == {"shop.example", None} and all(x.selected_version == 0x0304 for x in tls)
    assert "771,4865-49199,0-10-11-16-43,29-23,0" in {x.ja3 for x in tls}  # greased values are left out
    quic = s.where("protocol = 'quic'").select("quic.tls.client_hello.server_name", "quic.packets", "quic.cids").first()
    assert quic.server_name == "video.example" and [p.header_type for p in quic.packets] == ["Long", "Short"] and quic.packets[0].frames == ["Crypto", "Padding"]
    assert quic.cids == ["01020304", "8394c8f03e515708"]


def _naive(packets, idle):
    """first, last, packets, bytes, history, max idle of the connections of (id, us, a, ap, b, bp, proto, flags, len, size)."""
    by = defaultdict(list)
    for p in packets:
        by[tuple(sorted([(p[2], p[3]), (p[4], p[5])])), p[6]].append(p)
    out = []
    for ps in by.values():
        ps.sort(key=lambda p: (p[1], p[0]))
        runs = [[ps[0]]]
        for x, y in zip(ps, ps[1:], strict=False):
            if y[1] - x[1] > idle:
                runs.append([])
            runs[-1].append(y)
        for r in runs:
            orig, seen = (r[0][2], r[0][3]), []
            for p in r:
                marks = ([m for m, f in (("S", 2), ("H", 18)) if p[7] == f] + (["A"] if p[7] == 16 and not p[8] else []) + [m for m, f in (("F", 1), ("R", 4)) if p[7] & f] if p[6] == 6 else []) + (["D"] if p[8] else [])
                seen += [m for m in (m if (p[2], p[3]) == orig else m.lower() for m in marks) if m not in seen]
            out.append((r[0][1], r[-1][1], len(r), sum(p[9] for p in r), "".join(dict.fromkeys(seen)), max([b[1] - a[1] for a, b in zip(r, r[1:], strict=False)], default=0)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_features_random(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(300):
        a, b = r.sample([(1, 10), (2, 20), (3, 30)], 2)
        n = r.choice([0, 5])
        rows.append((i, r.randrange(0, 5_000_000_000), *a, *b, r.choice([6, 17]), 0, n, 60 + n))
    rows = [(*p[:7], r.choice([2, 18, 16, 17, 4, 24]) if p[6] == 6 else 0, *p[8:]) for p in rows]
    ip = lambda n: bytes([10, 0, 0, n])
    df = spark.createDataFrame([(p[0], p[1], ip(p[2]), p[3], ip(p[4]), p[5], p[6], p[7], p[8], p[9]) for p in rows], "pkt_id bigint, us bigint, src_ip binary, src_port int, dst_ip binary, dst_port int, proto int, tcp_flags int, payload_len int, frame_len int").withColumn("ts", F.timestamp_micros("us"))
    same = C.Timeouts(udp=90_000_000, tcp=90_000_000)
    got = sorted((x.first_us, x.last_us, x.pkt_count, x.byte_count, x.history, x.max_idle_us) for x in C.connections(df, same).collect())
    assert got == _naive(rows, 90_000_000)
    off = sorted((x.first_us, x.last_us, x.pkt_count, x.byte_count, x.history, x.max_idle_us) for x in C.connections(df, C.Timeouts(offline=True)).collect())
    assert off == _naive(rows, 1 << 62)
    assigned = C.assign(df, same)
    assert assigned.count() == len(rows)
    assert assigned.groupBy(*C.KEY, "conn_no").count().count() == len(got)
    numbered = C.assign(df, same, marks={"fin": F.col("tcp_flags") == 17}, numbers=True).collect()
    by = defaultdict(list)
    for x in sorted(numbered, key=lambda x: (x.us, x.pkt_id)):
        by[bytes(x.key_hi), bytes(x.key_lo), x.proto, x.conn_no].append(x)
    for ps in by.values():
        last = {}
        for i, x in enumerate(ps):
            assert x.nth == i + 1 and x.bytes_so_far == sum(p.frame_len for p in ps[: i + 1]) and x.fin == any(p.tcp_flags == 17 for p in ps)
            assert x.gap_us == (x.us - last[x.dir] if x.dir in last else None)
            last[x.dir] = x.us
    assert C.connections(df.limit(0)).count() == 0


def test_hot_flow_is_spread(spark):
    """A flow with a third of all packets: no window or join holds more of it than a cell or a block."""
    n = 60_000
    hot = F.col("id") % 3 == 0
    ip = lambda x: F.unhex(F.lpad(F.hex(x), 8, "0"))
    df = spark.range(n).select(F.col("id").alias("pkt_id"), F.timestamp_micros(F.col("id") * 10_000).alias("ts"), F.when(hot, ip(F.lit(1))).otherwise(ip(F.col("id") % 500 + 2)).alias("src_ip"), ip(F.lit(7)).alias("dst_ip"), F.lit(1).alias("src_port"), F.lit(2).alias("dst_port"), F.lit(6).alias("proto"), F.lit(24).alias("tcp_flags"), (F.col("id") * 100).alias("seq_no"), F.lit(100).alias("payload_len"), F.lit(154).alias("frame_len"))
    numbered = C.assign(df, numbers=True)
    top = numbered.where(F.hex("src_ip") == "00000001").agg(F.max("nth"), F.max("bytes_so_far"), F.max("gap_us")).collect()[0]
    assert tuple(top) == (n // 3, n // 3 * 154, 30_000)
    keyed = C.with_key(df).withColumn("cell", C.Timeouts().cell(F.unix_micros("ts")))
    assert keyed.groupBy(*C.KEY, "cell").count().agg(F.max("count")).first()[0] <= C.CELL // 30_000 + 1
    c = C.content(C.assign(df).where(F.hex("src_ip") == "00000001")).collect()
    assert [(x.n_chunks, x.missed_bytes) for x in c] == [(n // 3, 200 * (n // 3 - 1))]


def test_closing(spark):
    turns = samples.talk([(True, b"hello")], start=0)
    again = samples.talk([(True, b"more")], start=100_000, isn=90_000, close=False)
    reset = [(200_000, samples.tcp("198.18.0.9", 80, "10.0.0.1", 40000, 4))]
    late = [(300_000, samples.tcp("10.0.0.1", 40000, "198.18.0.9", 80, 16, 1, 1, b"late"))]
    rows = [(i, us, f) for i, (us, f) in enumerate(turns + again + reset + late)]
    df = decode(spark.createDataFrame(rows, "pkt_id bigint, us bigint, frame binary").withColumn("ts", F.timestamp_micros("us")))
    got = sorted((x.first_us, x.closed_by, x.pkt_count) for x in trace_connections(df, set()).collect())
    assert got == [(0, "fin", 7), (100_000, "rst", 5)]
    short = C.Timeouts(establish=500)
    assert {x.closed_by for x in trace_connections(df, set(), short).collect()} == {"idle"}
    assert trace_connections(df.limit(0)).count() == 0


class Largest:
    """A user's aggregate: the largest frame and the number of changes of direction."""

    def __init__(self):
        self.size, self.turns, self.last = 0, 0, None

    def update(self, frame_len, dir):
        self.size = max(self.size, frame_len)
        self.turns += self.last is not None and self.last != dir
        self.last = dir

    def result(self):
        return {"largest": self.size, "turns": self.turns}


def test_own_aggregate(frames):
    a = C.assign(frames, C.Timeouts(offline=True))
    got = {(x.largest, x.turns) for x in fold(a.where("dst_port = 53 or src_port = 53"), ["frame_len", "dir"], Largest, "largest bigint, turns int").collect()}
    assert got == {(89, 4)}
