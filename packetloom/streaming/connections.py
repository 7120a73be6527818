"""Connections of a stream of packets, delivered when they have been idle long enough by the watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.conntrack import KEY, Timeouts, finished, unordered, with_key
from packetloom.sources.tables import micros


def stream_connections(packets: DataFrame, timeouts: Timeouts = Timeouts(), late: str = "10 minutes") -> DataFrame:
    """Connections with their features, as operators.conntrack.connections() makes them from a table but for the times
    between packets, in append mode: delivered once the watermark has passed their idle time.

    Session windows of the transport's idle time; a packet exactly that long after the last is still of the connection, as
    in tables. Packets later than the watermark are dropped by Spark.
    """
    gap = F.when(F.col("proto") == 17, F.lit(f"{timeouts.udp + 1} microseconds")).otherwise(F.lit(f"{timeouts.tcp + 1} microseconds"))
    p = with_key(packets).withColumn("us", micros("ts")).withWatermark("ts", late)
    aggs = {"first_us": F.min("us"), "last_us": F.max("us"), "pkt_count": F.count(F.lit(1)), "byte_count": F.sum(F.col("frame_len").cast("bigint")), **unordered()}
    g = p.groupBy(F.session_window("ts", gap).alias("w"), *KEY).agg(*[c.alias(k) for k, c in aggs.items()])
    return finished(g, [])


def stream_counts(rows: DataFrame, labels: list[str]) -> DataFrame:
    """Counters by label, for complete or update mode."""
    return rows.groupBy(*labels).agg(F.count(F.lit(1)).alias("n"))
