"""Sessions, skew, pairing and rules against brute force, with nulls, ties, copies and empty tables."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from packetloom.functions.addresses import endpoint_address, endpoint_port, ip_bytes
from packetloom.operators.pairing import pair_by_transaction, pair_in_order
from packetloom.operators.rules import Rule, match_filters, match_prefixes, match_values
from packetloom.operators.sessions import sessionize
from packetloom.operators.skew import balanced_aggregate, balanced_join, pack, plan_placement, task_labels


def brute_sessions(rows, gap):
    by = defaultdict(list)
    for k, s, e in rows:
        if k is not None and s is not None:
            by[k].append((s, max(s, s if e is None else e)))
    out = []
    for k, spans in by.items():
        spans.sort()
        a, b, n = spans[0][0], spans[0][1], 0
        for s, e in spans:
            if s - b > gap:
                out.append((k, a, b, n))
                a, b, n = s, e, 0
            b, n = max(b, e), n + 1
        out.append((k, a, b, n))
    return sorted(out)


@pytest.mark.parametrize("seed", range(4))
def test_sessions_random(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(250):
        start = None if r.random() < 0.05 else r.randrange(-3000, 6000)
        rows.append((r.choice(["a", "b", None]), start, None if start is None or r.random() < 0.3 else start + r.randrange(-50, 400)))
    rows += [("hot", t, t) for t in range(0, 3000, 3)] + rows[:20]
    df = spark.createDataFrame([(*x, "noise", "noise") for x in rows], "k string, s bigint, e bigint, start_us string, n_events string")
    got = sorted((x.k, x.start_us, x.end_us, x.n_events) for x in sessionize(df, ["k"], "s", "e", 100).collect())
    assert got == brute_sessions(rows, 100)


def test_sessions_edges(spark):
    df = spark.createDataFrame([("a", 0, 10, 1), ("a", 110, 110, 2), ("a", 211, None, 3), ("a", 211, None, 3), ("a", 50, 5, 4)], "k string, s bigint, e bigint, id int")
    got = sorted((x.start_us, x.end_us, x.duration_us, x.n_events) for x in sessionize(df, ["k"], "s", "e", 60, count_id=["id"]).collect())
    assert got == [(0, 110, 110, 3), (211, 211, 0, 1)]  # exactly the gap stays inside; a copy counts once
    assert sessionize(df.limit(0), ["k"], "s", "e", 60).count() == 0
    with pytest.raises(ValueError):
        sessionize(df, ["k"], "s", "e", 0)


def test_packing():
    place, loads = pack([8, 7, 6, 5, 4], 2)
    assert sum(loads) == 30 and max(loads) <= 17 and len(place) == 5


def test_balanced(spark):
    r = random.Random(5)
    rows = [("hot" if i % 3 == 0 else None if i % 17 == 0 else f"k{r.randrange(40)}", i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, id bigint").repartition(7)
    p = plan_placement(df, ["k"], tasks=8, fraction=1.0)
    assert ("hot",) in p.heavy and len(p.heavy[("hot",)]) > 1
    assert max(p.loads) < 1.3 * sum(p.loads) / 8
    assert len(set(task_labels(spark, 8))) == 8
    got = {x.k: x.n for x in balanced_aggregate(df, ["k"], {"m": F.count(F.lit(1))}, {"n": F.sum("m")}, ["id"], p).collect()}
    assert got == Counter(k for k, _ in rows)
    twice = balanced_aggregate(df.unionByName(df), ["k"], {"m": F.count(F.lit(1))}, {"n": F.sum("m")}, ["id"], p, once=True)
    assert twice._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2  # by label, then by key
    assert {x.k: x.n for x in twice.collect()} == Counter(k for k, _ in set(rows))
    side = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("none", 4), (None, 5)], "k string, v int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = balanced_join(df, side, ["k"], ["id"], how, p)
        b = df.join(side, "k", how)
        assert Counter(a.select(*b.columns).collect()) == Counter(b.collect()), how
    assert balanced_join(df.limit(0), side, ["k"], ["id"]).count() == 0
    with pytest.raises(ValueError):
        balanced_join(df, side.withColumn("id", F.lit(1)), ["k"], ["id"])


def test_placed_rows_are_even(spark):
    """No task gets much more than its share although a key holds half of the rows."""
    df = spark.range(20000).select(F.when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), "id")
    p = plan_placement(df, ["k"], tasks=8, fraction=1.0)
    from packetloom.operators.skew import place_rows

    placed = place_rows(df, p, ["id"]).repartition(8, "__label").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert max(x["count"] for x in placed) < 1.35 * 20000 / 8


def test_addresses(spark):
    cases = {"10.1.2.3:80": ("10.1.2.3", 80), "[::ffff:1.2.3.4]:5": ("1.2.3.4", 5), "[2001:DB8:0:0::1]:7": ("2001:db8::1", 7), "[::FFFF:0a8f:aa19]:1": ("10.143.170.25", 1), "": (None, None), "[::1]:2": ("::1", 2), "[1:0:0:2:0:0:0:3]:1": ("1:0:0:2::3", 1)}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "e string")
    got = {x.e: (x.a, x.p) for x in df.select("e", endpoint_address(F.col("e")).alias("a"), endpoint_port(F.col("e")).alias("p")).collect()}
    assert got == {**cases, None: (None, None)}
    raw = df.select(F.hex(ip_bytes(endpoint_address(F.col("e")))).alias("h")).where("h is not null").collect()
    assert {"0A010203", "20010DB8000000000000000000000001"} <= {x.h for x in raw}


def test_pairing(spark):
    q = spark.createDataFrame([("c", 1, 5, "a"), ("c", 2, 5, "b"), ("d", 1, 7, None), (None, 1, 1, "x")], "conn string, at int, tx int, v string")
    r = spark.createDataFrame([("c", 1, 5, "A"), ("c", 9, 6, "B")], "conn string, at int, tx int, v string")
    got = {(x.conn, x.depth, x.request and x.request.v, x.response and x.response.v) for x in pair_in_order(q, r, ["conn"], ["at"]).collect()}
    assert got == {("c", 1, "a", "A"), ("c", 2, "b", "B"), ("d", 1, None, None), (None, 1, "x", None)}
    got = {(x.conn, x.tx, x.nth, x.query and x.query.v, x.response and x.response.v) for x in pair_by_transaction(q, r, ["conn"], "tx", ["at"]).collect()}
    assert {("c", 5, 1, "a", "A"), ("c", 5, 2, "b", None), ("c", 6, 1, None, "B")} <= got


def test_numbered_by_ranges(spark):
    from packetloom.operators.ordering import numbered

    r = random.Random(6)
    rows = [("hot", r.randrange(5000), i) for i in range(3000)] + [(f"k{i % 50}", r.choice([None, 1, 2, 3]), i) for i in range(500)] + [(None, 7, 1), (None, 8, 2)]
    df = spark.createDataFrame(rows, "k string, t bigint, id int")
    by = defaultdict(list)
    for x in numbered(df, ["k"], ["t", "id"], "n", 16).collect():
        by[x.k].append((x.n, x.t, x.id))
    assert sum(map(len, by.values())) == len(rows)
    for got in by.values():
        want = sorted(((t, i) for _, t, i in got), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        assert [(t, i) for _, t, i in sorted(got)] == want and [n for n, _, _ in sorted(got)] == list(range(1, len(got) + 1))
    assert numbered(df.limit(0), ["k"], ["t"], "n").count() == 0


def test_rules(spark):
    df = spark.createDataFrame([(1, 167772161, "x"), (2, 3323068416, None), (3, None, "y")], "id int, a bigint, v string")
    nets = spark.createDataFrame([("ten", 167772160, 8), ("all", 0, 0), ("host", 3323068416, 32)], "rule string, low bigint, prefix int")
    assert {(x.id, x.rule) for x in match_prefixes(df, nets, "a").collect()} == {(1, "ten"), (1, "all"), (2, "all"), (2, "host")}
    assert match_prefixes(df, nets.limit(0), "a").count() == 0
    eq = spark.createDataFrame([("r1", "x"), ("r2", "x")], "rule string, value string")
    assert {(x.id, x.rule) for x in match_values(df, eq, F.col("v")).collect()} == {(1, "r1"), (1, "r2")}
    p = spark.createDataFrame([(1, 4, 6, 80), (2, 4, 17, 53)], "pkt_id int, ip_version int, proto int, dst_port int")
    rules = [Rule("a", "tcp"), Rule("b", "tcp.dst_port = 80"), Rule("c", "tcp"), Rule("d", "udp.dst_port = 1")]
    assert {(x.pkt_id, x.rule) for x in match_filters(p, rules).collect()} == {(1, "a"), (1, "b"), (1, "c")}
    assert match_filters(p, []).count() == 0


def test_rule_index_equals_filters(spark):
    """Rules found by the index against each rule's own filter, with every kind of comparison."""
    from packetloom.filterlang import Filter, holds
    from packetloom.sources.adapters import flows_from_packets
    from packetloom.sources.tables import table
    from packetloom.sources.traffic import traffic_from_tables
    from tests.conftest import DATA

    texts = ["tcp.dst_port = 443 and ipv4.time_to_live >= 60", "udp.port = 53", "tcp.dst_port = 80 or udp.dst_port = 53", "tcp.port != 443 and tcp.dst_port = 22", "ipv4.time_to_live = 64 and tcp.syn = 1", "ipv4.dst_addr in 198.18.0.0/16 and tcp.dst_port = 443", "ipv6.addr in 2001:db8::/32 and udp.dst_port = 53", "tcp", "ipv4.src_addr != 10.0.0.0/9 and udp.src_port in 1000..60000 and udp.dst_port = 123", "tcp.dst_port = 443 and tcp.dst_port = 443", "ipv4.dst_addr = 198.18.0.37", ""]
    p = table(spark, DATA, "packets").distinct()
    got = Counter((x.rule, x.pkt_id) for x in match_filters(p, [Rule(t, t) for t in texts] + [Rule("twin", texts[0])]).select("rule", "pkt_id").collect())
    want = Counter((t, x.pkt_id) for t in texts for x in p.where(holds(Filter(t).on_packets(p.columns, exact=True))).select("pkt_id").collect())
    want.update(("twin", i) for (t, i) in list(want) if t == texts[0])
    assert got == want
    t = traffic_from_tables(spark, DATA)
    ends = [c for c in t.connections.columns if c not in t.sessions.columns or c == "conn_id"]
    rows = t.sessions.join(t.connections.select(*ends), "conn_id")
    texts = ["dns.query_domain = 'time.lumoss.example' and udp", "ssh.software_version_ctos = 'Ferrossh_3.2' and ssh.software_version_stoc contains 'sshd'", "ssh.protocol_version_ctos = |32 2E 30|", "ssh.software_version_ctos = 'Ferrossh_3.2' and ssh.key_exchange_cookie_stoc ~b '^[\\xf0-\\xff]'", "dns.query_domain ~ 'test$'", "tcp.dst_port = 22 and ssh.comments_ctos not contains 'x'", "dns.query_domain = 'api.lumgri.test' and dns.query_domain ~ 'l.m' or udp.dst_port = 53 and dns.query_domain != 'api.lumgri.test'"]
    got = Counter((x.rule, x.session_id) for x in match_filters(rows, [Rule(t, t) for t in texts], "session").select("rule", "session_id").collect())
    want = Counter((t, x.session_id) for t in texts for x in rows.where(holds(Filter(t).on_sessions())).select("session_id").collect())
    assert got == want and len({t for t, _ in got}) > 4
    conns = match_filters(flows_from_packets(spark, DATA).limit(0), [Rule("a", "tcp.dst_port = 1")])
    assert conns.count() == 0
