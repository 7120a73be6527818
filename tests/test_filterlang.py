import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packetloom.filterlang import Filter, errors
from packetloom.filterlang.analysis import excludes, implies
from packetloom.filterlang.ast import IntRange, Net, Predicate, reaches
from packetloom.filterlang.normalize import canonical, pruned
from packetloom.filterlang.parse import And, Or, parse
from packetloom.filterlang.regexes import to_jvm


def one(text):
    tree = parse(text)
    assert isinstance(tree, Predicate), tree
    return tree


@pytest.mark.parametrize(
    ("text", "error"),
    [
        ("tcp.port = ", errors.InvalidFormat), ("tcp.port", errors.InvalidFormat), ("(tcp", errors.InvalidFormat), ("tcp udp", errors.InvalidFormat), ("not tcp", errors.InvalidProtocol),
        ("gopher", errors.InvalidProtocol), ("tcp and udp", errors.InvalidPatternLayers), ("tcp.color = 1", errors.InvalidField), ("tcp.port ~ 'x'", errors.InvalidRhsType),
        ("tcp.port contains 5", errors.InvalidBinOp), ("tls.sni in 'x'", errors.InvalidBinOp), ("tcp.port in 9..2", errors.InvalidIntRange), ("tcp.port in 5..5", errors.InvalidIntRange),
        ("ipv4.addr = 1.2.3.400", errors.InvalidAddress), ("ipv4.addr = 1.2.3.4/40", errors.InvalidPrefixLen), ("tcp.port = 99999999999999999999999", errors.InvalidInt),
        ("http.uri = |ABCD|", errors.InvalidRhsValue), ("ipv6.addr = 1.2.3.4", errors.InvalidRhsType), ("tls.sni ~ '(?U)a'", None),
    ],
)
def test_errors(text, error):
    if error is None:
        Filter(text)
    else:
        with pytest.raises(error):
            Filter(text)


def test_precedence_and_spellings():
    assert isinstance(parse("ipv4 and tcp or udp"), Or)
    assert isinstance(parse("ipv4 && (tcp || udp)"), And)
    for a, b in (("tcp.src_port ge 5", "tcp.src_port >= 5"), ("http.uri matches 'a'", "http.uri ~ 'a'"), ("http.uri !contains 'a'", "http.uri not contains 'a'"), ("tcp.src_port ne 5", "tcp.src_port != 5")):
        assert parse(a) == parse(b)
    assert one("ipv6.src_addr = 2001:db8::/32").value == Net(6, 0x20010DB8 << 96, 32)
    assert one("tcp.src_port in 1..9").value == IntRange(1, 9)
    assert one("http.uri contains |41 42|").value == b"AB"


def test_combined_fields():
    assert isinstance(parse("tcp.port = 80"), Or)
    assert isinstance(parse("tcp.port != 80"), And)
    assert len(Filter("ipv4.addr = 1.2.3.4").patterns) == 2
    assert len(Filter("ipv4.addr != 1.2.3.4").patterns) == 1


def test_qualified():
    assert [[p.proto for p in q] for q in Filter("tcp").patterns] == [["ethernet", "ipv4", "tcp"], ["ethernet", "ipv6", "tcp"]]
    assert len(Filter("dns").patterns) == 4
    assert Filter("").patterns == [(Predicate("ethernet"),)]
    assert len(pruned(canonical(parse("ipv4 or ipv4 and tcp or ipv4.src_addr = 1.1.1.1")))) == 1
    assert reaches("ipv4", "http") and not reaches("udp", "http") and not reaches("tcp", "ipv4")


def test_stages():
    assert Filter("tcp.port = 1").stage() == "packet"
    assert Filter("tls and tcp.port = 1").stage() == "protocol"
    assert Filter("tls.sni = 'x'").stage() == "session"
    assert Filter("tcp.syn = 1").per_packet() and not Filter("tcp.port = 1").per_packet()
    with pytest.raises(errors.InvalidPredType):
        Filter("tcp.syn = 1").on_connections()


@pytest.mark.parametrize(
    ("a", "b", "yes"),
    [
        ("ipv4.src_addr = 1.2.3.1/31", "ipv4.src_addr = 1.2.3.1/30", True), ("ipv4.src_addr = 1.2.3.1/30", "ipv4.src_addr = 1.2.3.1/31", False), ("tcp.src_port = 5", "tcp.src_port in 1..9", True),
        ("tcp.src_port in 2..5", "tcp.src_port in 1..9", True), ("tcp.src_port in 2..50", "tcp.src_port in 1..9", False), ("tcp.src_port > 9", "tcp.src_port >= 9", True), ("tcp.src_port < 9", "tcp.src_port <= 8", True),
        ("tcp.src_port = 5", "tcp.src_port != 6", True), ("http.uri = 'abc'", "http.uri contains 'b'", True), ("http.uri = 'abc'", "http.uri ~ '^a'", True), ("http.uri contains 'abc'", "http.uri contains 'b'", True),
        ("http.uri not contains 'b'", "http.uri not contains 'abc'", True), ("tcp.src_port = 5", "tcp", True), ("tcp", "tcp.src_port = 5", False), ("tcp.src_port = 5", "tcp.dst_port = 5", False),
    ],
)
def test_implies(a, b, yes):
    assert implies(one(a), one(b)) is yes


@pytest.mark.parametrize(
    ("a", "b", "yes"),
    [
        ("ipv4", "ipv6", True), ("tcp", "udp", True), ("tcp.src_port = 5", "tcp.src_port = 6", True), ("tcp.src_port in 1..5", "tcp.src_port > 5", True), ("tcp.src_port in 1..5", "tcp.src_port >= 5", False),
        ("ipv4.src_addr = 1.2.3.0/31", "ipv4.src_addr = 1.2.4.0/24", True), ("ipv4.src_addr in 1.2.3.0/24", "ipv4.src_addr = 1.2.3.9", False), ("http.uri = 'a'", "http.uri != 'a'", True),
        ("http.uri contains 'ab'", "http.uri not contains 'b'", True), ("http.uri = 'a'", "http.method = 'b'", False), ("tcp.src_port = 5", "tcp.src_port != 5", True),
    ],
)
def test_excludes(a, b, yes):
    assert excludes(one(a), one(b)) is yes
    assert excludes(one(b), one(a)) is yes


def test_regexes(spark):
    cases = [("c$", "abc\n", False), ("a.b", "a\rb", True), ("a.b", "a\nb", False), (r"^\w$", "é", True), ("[$]", "$", True), (r"\$", "$", True), ("(?i)ABC", "xabcx", True), ("(?P<n>b)c", "abc", True)]
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(cases)], "i int, t string")
    for i, (p, _, yes) in enumerate(cases):
        assert df.where(F.col("i") == i).select(F.col("t").rlike(to_jvm(p, False))).first()[0] is yes, p
    with pytest.raises(errors.InvalidRhsValue):
        to_jvm("(?U)a", False)
    assert df.limit(1).select(F.decode(F.lit(b"\xfe\x01"), "ISO-8859-1").rlike(to_jvm(r"^[\xf0-\xff]", True))).first()[0]


# Random filters against an interpreter of the tree, over packets with every kind of gap.

PACKETS = [
    (0, 4, 6, 167772161, 3323068416, 40000, 443, 64, 2), (1, 4, 17, 167772162, 3323068417, 40000, 53, 128, 0), (2, 6, 6, None, None, 443, 40000, None, 18), (3, 4, 6, 3323068416, 167772161, 443, 40000, 63, 16),
    (4, 4, 17, 167772161, 167772162, None, None, 1, 0), (5, 6, 17, None, None, 53, 53, None, 0), (6, 4, None, 1, 2, None, None, 5, None),
]
NAMES = ["i", "ip_version", "proto", "src_addr", "dst_addr", "src_port", "dst_port", "time_to_live", "tcp_flags"]
LEAVES = ["tcp", "udp", "ipv4", "ipv6", "tcp.port = 443", "udp.port != 53", "tcp.src_port > 1000", "ipv4.addr in 10.0.0.0/8", "ipv4.addr != 10.0.0.1", "ipv4.time_to_live in 60..70", "tcp.syn = 1", "tcp.dst_port = 443", "udp.src_port <= 53"]
trees = st.recursive(st.sampled_from(LEAVES), lambda s: st.tuples(s, st.sampled_from(["and", "or"]), s).map(lambda x: f"({x[0]} {x[1]} {x[2]})"), max_leaves=4)


def naive(tree, row):
    if isinstance(tree, Or):
        return any(naive(t, row) for t in tree.parts)
    if isinstance(tree, And):
        return all(naive(t, row) for t in tree.parts)
    layer = {"ipv4": row["ip_version"] == 4, "ipv6": row["ip_version"] == 6, "tcp": row["proto"] == 6, "udp": row["proto"] == 17}[tree.proto]
    if tree.unary or not layer:
        return layer
    v = (1 if row["tcp_flags"] & 2 else 0) if tree.field == "syn" else row[tree.field]
    if v is None:
        return False
    x, op = tree.value, str(tree.op)
    low, high = (x.low, x.high) if isinstance(x, Net | IntRange) else (x, x)
    return {"=": low <= v <= high, "in": low <= v <= high, "!=": not low <= v <= high, ">": v > high, "<=": v <= high}[op]


@settings(max_examples=25, deadline=None)
@given(trees)
def test_random_filters(spark, text):
    tree = parse(text)
    try:
        f = Filter(text)
    except errors.InvalidPatternLayers:
        return
    df = spark.createDataFrame(PACKETS, "i int, ip_version int, proto int, src_addr bigint, dst_addr bigint, src_port int, dst_port int, time_to_live int, tcp_flags int")
    got = {r.i for r in df.where(f.on_packets(df.columns, exact=True)).select("i").collect()}
    rows = [dict(zip(NAMES, r, strict=True)) for r in PACKETS]
    assert got == {r["i"] for r in rows if naive(tree, r)}
    # a pattern's conjunction and the tree agree
    assert got == {r["i"] for r in rows if any(all(p.proto == "ethernet" or naive(p, r) for p in q) for q in f.patterns)}


def test_pattern_texts():
    for q in Filter("tcp.port in 1..5 and ipv4.addr = 10.0.0.0/8 or http.uri contains 'x'").patterns:
        for p in q:
            if not p.unary:
                assert re.search(r"\.", str(p))
                assert parse(str(p)) == p
