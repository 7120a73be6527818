"""Readers of the parquet tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table name.parquet of a folder, a file or a directory of files."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def day(ts: str | Column) -> Column:
    """The UTC date of a time as yyyy-MM-dd; null if the time is null."""
    return F.to_date(F.col(ts) if isinstance(ts, str) else ts).cast("string")


def micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a zone-less or zoned time."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_micros(c.cast("timestamp"))
