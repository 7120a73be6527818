"""Sessions of activity separated by idle time, by a sweep over deltas.

Every interval opens with +1 at its start and closes with -1 at its end plus the gap; where the running sum of a key
returns to zero, a session closes. The sweep needs the rows of a key in order, so rows are thinned before it: starts in
one cell of the gap's length lie less than a gap apart, hence always belong to one session, and are replaced by their
hull while still on the map side. A key then has at most two deltas for each gap of the time covered, however many rows
it holds, so no hot key makes a long task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessionize(rows: DataFrame, keys: list[str], start: str, end: str, gap: int, count_id: list[str] | None = None) -> DataFrame:
    """One row for each session of each key: keys, start_us, end_us, duration_us, n_events.

    start and end are BIGINT columns in the unit of gap. An event ends at its start if end is null or earlier. Exactly
    gap idle stays inside a session. Rows with a null key or start belong to no session. With count_id, rows equal in
    those columns, keys, start and end are one event; without, n_events counts rows and copies only add to n_events.
    Other columns are ignored, an empty table gives no rows.
    """
    if gap < 1:
        raise ValueError("gap must be positive")
    s, e = F.col(start).cast("bigint"), F.col(end).cast("bigint")
    named = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    ks = [f"__k{i}" for i in range(len(keys))]
    base = rows.select(*named, *[F.col(c).alias(f"__i{i}") for i, c in enumerate(count_id or [])], s.alias("__s"), F.greatest(s, F.coalesce(e, s)).alias("__e"))
    base = base.where(F.col("__s").isNotNull())
    for k in ks:
        base = base.where(F.col(k).isNotNull())
    if count_id:
        base = base.distinct()
    hulls = base.groupBy(*ks, (F.col("__s") - F.pmod("__s", F.lit(gap))).alias("__cell")).agg(F.min("__s").alias("__s"), F.max("__e").alias("__e"), F.count(F.lit(1)).alias("__n"))
    none = F.lit(0).cast("bigint")
    deltas = hulls.select(*ks, F.explode(F.array(F.struct(F.col("__s").alias("__t"), F.lit(1).alias("__d"), F.col("__n").alias("__n")), F.struct((F.col("__e") + gap).alias("__t"), F.lit(-1).alias("__d"), none.alias("__n")))).alias("__x")).select(*ks, "__x.*")
    sweep = W.partitionBy(*ks).orderBy(F.col("__t"), F.col("__d").desc())
    upto = sweep.rowsBetween(W.unboundedPreceding, W.currentRow)
    closed = deltas.withColumn("__zero", F.when(F.sum("__d").over(upto) == 0, 1).otherwise(0))
    numbered = closed.withColumn("__no", F.sum("__zero").over(upto) - F.col("__zero"))
    out = numbered.groupBy(*ks, "__no").agg(F.min("__t").alias("start_us"), (F.max("__t") - gap).alias("end_us"), F.sum("__n").alias("n_events"))
    return out.select(*[F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)], "start_us", "end_us", (F.col("end_us") - F.col("start_us")).alias("duration_us"), "n_events")
