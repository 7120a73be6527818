"""Run configuration of a TOML file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.conntrack import Timeouts, with_key

#: Buckets that flows fall into.
FLOW_BUCKETS = 512


@dataclass(frozen=True)
class Offline:
    pcap: str
    mtu: int = 9702


@dataclass(frozen=True)
class Online:
    """Folders in which captures of each port arrive; their packets are a union with the port's number."""

    folders: tuple[str, ...]
    mtu: int = 9702
    seconds: int | None = None
    buckets: int = 512  # of 512 flow buckets; fewer sample flows


@dataclass(frozen=True)
class Config:
    offline: Offline | None = None
    online: Online | None = None
    timeouts: Timeouts = field(default_factory=Timeouts)
    max_out_of_order: int = 100

    def __post_init__(self) -> None:
        if (self.offline is None) == (self.online is None):
            raise ValueError("exactly one of online and offline must be set")


def load_config(path: str) -> Config:
    with open(path, "rb") as f:
        raw = tomllib.load(f)
    off, on, track = raw.get("offline"), raw.get("online"), raw.get("conntrack", {})
    ms = lambda k, d: int(track.get(k, d)) * 1000
    return Config(
        Offline(off["pcap"], int(off.get("mtu", 9702))) if off else None,
        Online(tuple(p["folder"] for p in on["ports"]), int(on.get("mtu", 9702)), on.get("duration"), int(on.get("nb_buckets", 512))) if on else None,
        Timeouts(ms("udp_inactivity_timeout", 60_000), ms("tcp_inactivity_timeout", 300_000), ms("tcp_establish_timeout", 5_000), offline=off is not None),
        int(track.get("max_out_of_order", 100)),
    )


def load_packets(spark, config: Config):
    """Decoded frames of a configuration: a table offline, a stream online, with port_id."""
    from packetloom.functions.headers import decode
    from packetloom.sources import pcap

    pcap.register(spark)
    if config.offline:
        return decode(pcap.read(spark, config.offline.pcap, config.offline.mtu)).withColumn("port_id", F.lit(0))
    out = None
    for i, folder in enumerate(config.online.folders):
        one = decode(spark.readStream.format("pcap").option("mtu", config.online.mtu).load(folder)).withColumn("port_id", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return sample_flows(out, config.online.buckets) if config.online.buckets < FLOW_BUCKETS else out


def sample_flows(packets: DataFrame, buckets: int) -> DataFrame:
    """Packets of the flows in the first of FLOW_BUCKETS buckets: whole flows, both directions, the same in every run and
    in other engines, as the bucket comes from the MD5 of the ends. Packets without ports belong to no flow."""
    digest = F.md5(F.concat(F.hex("key_hi"), F.hex("key_lo"), F.col("proto").cast("string")).cast("binary"))
    bucket = F.pmod(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), F.lit(FLOW_BUCKETS))
    return with_key(packets).where(bucket < buckets).drop("key_hi", "key_lo", "from_hi")
