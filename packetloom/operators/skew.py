"""Per-key results where a few keys hold most rows: fragment and replicate by estimated load.

A sample gives the load of each heavy key and of each hash class of the light ones. Heavy keys are cut into shards in
proportion to their load, then shards and classes are packed onto tasks, largest first. Rows go to the task of their
shard or class; rows of a matching side are copied to the tasks of a heavy key's shards only.

What reaches the driver is bounded by the number of tasks: a key is heavy if it has at least 1/(HEAVY * tasks) of the
rows, so there are at most HEAVY * tasks of them, and CLASSES * tasks classes.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.plans.staging import stage

HEAVY, CLASSES = 8, 16


@dataclass(frozen=True)
class Placement:
    """Which task holds which key. heavy: key values to the labels of their shards; classes: label of each hash class."""

    tasks: int
    keys: tuple[str, ...]
    heavy: dict[tuple, list[int]]
    classes: list[int]
    loads: list[float]


def _class(keys: tuple[str, ...], n: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(n)).cast("int")


def task_labels(spark: SparkSession, tasks: int) -> list[int]:
    """For each of the tasks a BIGINT that Spark's hash partitioning sends to it, so that packing decides the place."""
    found: dict[int, int] = {}
    low, step = 0, 40 * tasks
    while len(found) < tasks:
        for r in spark.range(low, low + step).select("id", F.pmod(F.hash("id"), F.lit(tasks)).alias("p")).collect():
            found.setdefault(r.p, r.id)
        low += step
    return [found[i] for i in range(tasks)]


def pack(loads: list[float], tasks: int) -> tuple[list[int], list[float]]:
    """Largest load first onto the task with the least so far; the task of each load, and the load of each task."""
    heap = [(0.0, t) for t in range(tasks)]
    place = [0] * len(loads)
    for i in sorted(range(len(loads)), key=lambda j: -loads[j]):
        have, t = heapq.heappop(heap)
        place[i] = t
        heapq.heappush(heap, (have + loads[i], t))
    out = [0.0] * tasks
    for have, t in heap:
        out[t] = have
    return place, out


def plan_placement(rows: DataFrame, keys: list[str], tasks: int | None = None, fraction: float = 0.1, seed: int = 7) -> Placement:
    """Estimates loads on a sample (only the placement depends on it, never a result) and packs them onto tasks."""
    spark = rows.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    seen = rows.select(*keys)
    if fraction < 1:
        seen = seen.sample(fraction, seed)
    # written, as it is read twice: rows are scanned once for their loads
    counts = stage(seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c")), "loads")
    total = counts.agg(F.coalesce(F.sum("__c"), F.lit(0))).collect()[0][0]
    least = max(1.0, total / (HEAVY * tasks))
    n = CLASSES * tasks
    is_heavy = F.col("__c") > least
    got = counts.groupBy(*[F.when(is_heavy, F.col(k)).alias(k) for k in keys], F.when(~is_heavy, _class(tuple(keys), n)).alias("__class")).agg(F.sum("__c").alias("__load")).collect()
    target = max(1.0, total / tasks / 4)
    items: list[tuple[str, object, float]] = []
    classes = {r["__class"]: r["__load"] for r in got if r["__class"] is not None}
    items += [("class", c, float(classes.get(c, 0)) + 0.5 / n) for c in range(n)]
    for r in got:
        if r["__class"] is None:
            shards = max(1, min(tasks, math.ceil(r["__load"] / target)))
            items += [("heavy", tuple(r[k] for k in keys), r["__load"] / shards)] * shards
    place, loads = pack([x[2] for x in items], tasks)
    labels = task_labels(spark, tasks)
    heavy: dict[tuple, list[int]] = {}
    of_class = [0] * n
    for (kind, what, _), t in zip(items, place, strict=True):
        if kind == "class":
            of_class[what] = labels[t]
        else:
            heavy.setdefault(what, []).append(labels[t])
    return Placement(tasks, tuple(keys), heavy, of_class, loads)


def _tables(df: DataFrame, p: Placement) -> tuple[DataFrame, DataFrame]:
    spark = df.sparkSession
    fields = ", ".join(f"__h{i} {df.schema[k].dataType.simpleString()}" for i, k in enumerate(p.keys))
    heavy = spark.createDataFrame([(*k, v) for k, v in p.heavy.items()], f"{fields}, __labels array<bigint>")
    return heavy, spark.createDataFrame(list(enumerate(p.classes)), "__class int, __label bigint")


def _match(p: Placement) -> Column:
    cond = F.lit(True)
    for i, k in enumerate(p.keys):
        cond = cond & F.col(k).eqNullSafe(F.col(f"__h{i}"))
    return cond


def place_rows(rows: DataFrame, p: Placement, spread: list[str]) -> DataFrame:
    """rows with __label, the task of their key; rows of a heavy key are spread over its shards by the columns named."""
    heavy, classes = _tables(rows, p)
    cols = [F.col(c) for c in rows.columns]
    x = rows.join(F.broadcast(heavy), _match(p), "left").withColumn("__class", _class(p.keys, len(p.classes))).join(F.broadcast(classes), "__class", "left")
    shard = F.get("__labels", F.pmod(F.xxhash64(*spread), F.size("__labels")).cast("int"))
    return x.select(*cols, F.when(F.col("__labels").isNotNull(), shard).otherwise(F.col("__label")).alias("__label"))


def replicate_rows(match: DataFrame, p: Placement) -> DataFrame:
    """Rows of the matching side with __label: one copy for each task that has a shard of the key, one for a light key."""
    heavy, classes = _tables(match, p)
    cols = [F.col(c) for c in match.columns]
    x = match.join(F.broadcast(heavy), _match(p), "left").withColumn("__class", _class(p.keys, len(p.classes))).join(F.broadcast(classes), "__class", "left")
    return x.select(*cols, F.explode(F.when(F.col("__labels").isNotNull(), F.array_distinct("__labels")).otherwise(F.array("__label"))).alias("__label"))


def balanced_aggregate(rows: DataFrame, keys: list[str], partial: dict[str, Column], merge: dict[str, Column], spread: list[str], placement: Placement | None = None, once: bool = False) -> DataFrame:
    """Per-key aggregates. partial: aggregates of a shard by name; merge: the same names from those of all shards.

    Null keys form groups of their own, as in GROUP BY. An empty table gives no rows. Columns not named are not moved.
    once: rows equal in keys and spread are one. Copies come to the same shard, so they are dropped there, without a
    shuffle of their own; partial then sees only keys and spread.
    """
    p = placement or plan_placement(rows, keys)
    placed = place_rows(rows.select(*keys, *[c for c in spread if c not in keys]) if once else rows, p, spread).repartition(p.tasks, "__label")
    if once:
        placed = placed.distinct()
    shards = placed.groupBy("__label", *keys).agg(*[c.alias(n) for n, c in partial.items()])
    return shards.groupBy(*keys).agg(*[c.alias(n) for n, c in merge.items()])


def balanced_join(rows: DataFrame, match: DataFrame, keys: list[str], spread: list[str], how: str = "inner", placement: Placement | None = None) -> DataFrame:
    """rows joined with match on equal keys without long tasks for heavy keys; rows keep their number of partners.

    how is inner, left, left_semi or left_anti. Null keys match nothing. Columns of match that are also columns of rows
    must be renamed before, but for the keys.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how: {how}")
    clash = (set(rows.columns) & set(match.columns)) - set(keys)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    p = placement or plan_placement(rows, keys)
    # both sides are placed by the label alone; the join must not shuffle again to spread by all of its keys
    rows.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    left = place_rows(rows, p, spread).repartition(p.tasks, "__label")
    right = replicate_rows(match, p).repartition(p.tasks, "__label")
    return left.join(right, ["__label", *keys], how).drop("__label")
