"""Numbers of rows in the order of their key, without a key's rows ever being ordered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges of the order that a key's rows fall into; as many tasks may share a key that holds most of them.
RANGES = 64


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str, ranges: int = RANGES) -> DataFrame:
    """df with the number, from 1, of each row among those of its keys by the columns of order.

    The first column of order must be a number or a time: percentiles of it cut the rows of every key into ranges, which
    are numbered each by itself, on top of the counts of earlier ranges. Where the cuts fall changes no number. Rows equal
    in order are told apart by their other columns, and if these are equal too, it doesn't matter. Nulls come first.
    """
    kind = df.schema[order[0]].dataType.typeName()
    first = F.unix_micros(F.col(order[0]).cast("timestamp")) if kind.startswith("timestamp") else F.col(order[0])
    value = first.cast("double")
    points = [i / ranges for i in range(1, ranges)]
    cuts = sorted(set(df.agg(F.percentile_approx(value, F.array(*map(F.lit, points)), 1000)).collect()[0][0] or []))
    part = F.lit(0)
    for c in reversed(cuts):
        part = F.when(value <= c, F.lit(cuts.index(c))).otherwise(part if c != cuts[-1] else F.lit(len(cuts)))
    placed = df.withColumn("__part", F.when(value.isNull(), -1).otherwise(part))
    others = [c for c in df.columns if c not in keys and c not in order]
    tie = [F.xxhash64(*others)] if others else []
    w = W.partitionBy(*keys, "__part").orderBy(*order, *tie)
    inner = placed.withColumn("__n", F.row_number().over(w))
    counts = placed.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), before.alias("__before"))
    on = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    return inner.join(offsets, on).select(*df.columns, (F.col("__n") + F.col("__before")).cast("int").alias(name))
