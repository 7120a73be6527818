"""What breaks on large tables only: keys of any size, joins by estimates that are far too small."""

import struct

from pyspark.sql import functions as F
from tests.conftest import DATA

from packetloom.functions.headers import decode
from packetloom.queries import protocols
from packetloom.sources import pcap, samples
from packetloom.sources.conversations import frames_of, turn


def test_large_keys(spark):
    keys = [0, 5, 3_500_000_000, 25_000_360_001, (1 << 39) - 1]
    c = spark.createDataFrame([(k,) for k in keys], "conn bigint").select("conn", F.array(turn(True, F.lit("6162"))).alias("turns"), F.lit("fin").alias("close"))
    rows = decode(frames_of(c, 80)).where("tcp_flags in (2, 18)").select((F.col("pkt_id") / 4096).cast("bigint").alias("k"), "tcp_flags", "seq_no").collect()
    assert {(x.k, x.tcp_flags): x.seq_no for x in rows} == {(k, f): s % (1 << 32) for k in keys for f, s in ((2, k * 2654435761), (18, k * 40503 + 77777))}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sessions_traced_once(spark):
    assert plan(protocols.prs_ssh(spark, DATA)).count("MapInArrow") == 1


def test_no_broadcast_of_reassembled(spark):
    p = plan(protocols.ct_reassembly(spark, DATA))
    assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p


def test_cut_inside_a_header_that_leads_to_a_record(spark, tmp_path):
    # bytes 30 to 45 of a record look like a header of 1,600 bytes: its frames of 64 bytes let it lead to a true one
    frames = [(i * 1000, samples.tcp("10.0.0.1", 20000, "198.18.0.1", 5555, 16, i, i, b"q" * 10)) for i in range(40_000)]
    frames = [(us, f[:18] + b"\0\0\0\0" + struct.pack("<I", 1554)[:4] + f[26:]) for us, f in frames]
    pcap.write_pcap(str(tmp_path / "x.pcap"), frames)
    split = 24 + 80 * 12_000 + 5
    df = pcap.read(spark, str(tmp_path / "x.pcap"), split_bytes=split)
    assert df.rdd.getNumPartitions() > 2 and df.count() == df.select("pkt_id").distinct().count() == len(frames)


def test_golden_joins_nothing(spark):
    assert "Join" not in plan(protocols.ex_golden(spark, DATA))


def test_session_lists_join_nothing(spark):
    assert "Join" not in plan(protocols.agg_sessionlist(spark, DATA))


def test_no_broadcast_of_frames(spark):
    p = plan(protocols.agg_pktframes(spark, DATA))
    assert "SortMergeJoin" in p and "BroadcastHashJoin" not in p


def test_websites_join_only_tables(spark):
    assert plan(protocols.ex_websites(spark, DATA)).count("Join ") <= 1
