"""Session settings the engine is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

from packetloom.plans.shipping import ship

#: Settings for any master. Arrow is needed by the parsers, UTC by every comparison of times.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.python.filterPushdown.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int = 8, memory: str = "8g", **extra: str) -> SparkSession:
    """A session on local[cpus] with as many shuffle partitions as threads."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("packetloom")
    for k, v in SETTINGS.items():
        b = b.config(k, v)
    b = b.config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", memory)
    for k, v in extra.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
