"""Counters, rates and plans of running queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from packetloom.filterlang import Filter, holds
from packetloom.filterlang.normalize import pruned
from packetloom.functions.net import CHECKSUM, GAP, PREAMBLE
from packetloom.plans.subscribe import Subscription


def counted(packets: DataFrame, ignored_by: Filter | None = None) -> tuple[DataFrame, Observation]:
    """packets, and counters that are filled while some action runs over them, without a pass of their own."""
    seen = Observation("packets")
    size = F.coalesce("frame_len", F.lit(0)).cast("bigint")
    one = lambda c, v: F.coalesce(F.sum(F.when(c, v)), F.lit(0)).cast("bigint")
    metrics = [one(F.lit(True), 1).alias("total_pkts"), one(F.lit(True), size).alias("total_bytes"), one(F.col("proto") == 6, 1).alias("tcp_pkts"), one(F.col("proto") == 6, size).alias("tcp_bytes"), one(F.col("proto") == 17, 1).alias("udp_pkts"), one(F.col("proto") == 17, size).alias("udp_bytes")]
    if ignored_by:
        kept = holds(ignored_by.on_packets(packets.columns))
        metrics += [one(~kept, 1).alias("ignored_pkts"), one(~kept, size).alias("ignored_bytes")]
    return packets.observe(seen, *metrics), seen


def tracking_counters(packets: DataFrame, connections: DataFrame) -> DataFrame:
    """One row: connections that began by transport, and the packets and bytes of TCP that belong to none, being in the
    middle of a connection whose start was not seen. connections: trace_connections() of these packets."""
    both = packets.where(F.col("proto").isin(6, 17) & F.col("src_port").isNotNull() & F.col("ts").isNotNull()).select("proto", F.lit(1).alias("n"), F.col("frame_len").cast("bigint").alias("size"), F.lit(0).alias("new"))
    held = connections.select("proto", (-F.col("pkt_count")).alias("n"), (-F.col("byte_count")).alias("size"), F.lit(1).alias("new"))
    one = lambda proto, c: F.coalesce(F.sum(F.when(F.col("proto") == proto, F.col(c))), F.lit(0)).cast("bigint")
    return both.unionByName(held).agg(one(6, "new").alias("tcp_new_connections"), one(17, "new").alias("udp_new_connections"), one(6, "n").alias("dropped_mid_tcp_pkts"), one(6, "size").alias("dropped_mid_tcp_bytes"))


def rates(counters: dict, seconds: float, dropped: int = 0) -> dict[str, float]:
    """Packets and wire bits a second, and the share dropped."""
    n, size = counters["total_pkts"], counters["total_bytes"]
    s = max(seconds, 1e-9)
    return {"pps": n / s, "ingress_bps": (size + n * (PREAMBLE + GAP)) * 8 / s, "good_bps": (size + n * (PREAMBLE + GAP + CHECKSUM)) * 8 / s, "dropped_percent": 100 * dropped / (n + dropped) if n + dropped else 0.0}


def progress_rates(progress: dict) -> dict[str, float]:
    """The same of a streaming query's last progress."""
    return {"rows_per_second": progress.get("processedRowsPerSecond", 0.0), "input_rows_per_second": progress.get("inputRowsPerSecond", 0.0), "batch_ms": progress.get("durationMs", {}).get("triggerExecution", 0)}


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Percentiles of a timing column from p05 to p99.9."""
    points = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999)
    return df.agg(*[F.percentile_approx(column, p, 10000).alias(f"p{str(p)[2:].ljust(2, '0')}") for p in points])


def plan(df: DataFrame) -> str:
    """The formatted plan."""
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def report(subs: list[Subscription]) -> str:
    """What each subscription costs: the stage that decides its filter, its grain, the parsers it needs, the conjunctions
    of its filter, and the condition under which a packet of its traffic is kept at all."""
    lines = []
    for s in subs:
        f = s.parsed
        lines.append(f"{s.name}({', '.join(s.datatypes)}): filter {s.filter or '(all)'}")
        lines.append(f"  decided by: {f.stage()}; delivered by: {s.level.name.lower()}{f', every {s.streaming[1]} {s.streaming[0]}' if s.streaming else ''}; parsers: {', '.join(sorted(s.protocols)) or 'none'}")
        lines += [f"  or {' and '.join(str(p) for p in q if p.proto != 'ethernet') or '(all)'}" for q in pruned(f.patterns)]
    return "\n".join(lines)
