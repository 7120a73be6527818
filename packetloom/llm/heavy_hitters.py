"""Most frequent values by a hierarchical count-sketch over hash-bit prefixes.

Each value is hashed to 32 bits. For every prefix length of LEVELS a count-sketch with signed hashes counts the prefixes,
so a sketch has the same size whatever the number of rows and distinct values. Sketches of partitions, files or days
add up. Descending from short prefixes to long, only prefixes whose estimate reaches the limit less the slack are
followed, each to its next bits; a second scan counts the values behind the surviving hashes exactly.

Count-sketch error: an estimate is off by more than 3 * L2 / sqrt(WIDTH) in one row with probability under 1/9, in the
median of DEPTH rows far more seldom; L2, the root of the sum of squared counts, is at most the number of occurrences.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS, DEPTH, WIDTH = (8, 16, 24, 32), 7, 8192
CELLS = len(LEVELS) * DEPTH * WIDTH
#: Odd multipliers of the bucket and sign hashes, drawn from a fixed seed: sketches made apart can be added.
_MULT = np.random.default_rng(20270201).integers(1, 2**63, size=(len(LEVELS), DEPTH, 2), dtype=np.uint64) | np.uint64(1)


def _places(prefix: np.ndarray, level: int, row: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and sign of each prefix in a row of a level."""
    x = (prefix.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * _MULT[level, row, 0]
    x ^= x >> np.uint64(29)
    x *= _MULT[level, row, 1]
    bucket = (x >> np.uint64(51)).astype(np.int64)  # 13 bits: WIDTH
    sign = 1.0 - 2.0 * ((x >> np.uint64(50)) & np.uint64(1)).astype(np.float64)
    return bucket, sign


def update(cells: np.ndarray, hashes: np.ndarray, weights: np.ndarray | None = None) -> None:
    """Adds hashes (their low 32 bits) to the cells of one sketch."""
    h = hashes.astype(np.int64) & 0xFFFFFFFF
    for level, bits in enumerate(LEVELS):
        prefix = h >> (32 - bits)
        for row in range(DEPTH):
            bucket, sign = _places(prefix, level, row)
            part = np.bincount(bucket, sign if weights is None else sign * weights, WIDTH)
            cells[level, row] += part.astype(np.int64)


def estimate(cells: np.ndarray, level: int, prefixes: np.ndarray) -> np.ndarray:
    """The estimated count of each prefix of a level."""
    rows = []
    for row in range(DEPTH):
        bucket, sign = _places(prefixes, level, row)
        rows.append(cells[level, row][bucket] * sign)
    return np.median(np.array(rows), axis=0)


def descend(cells: np.ndarray, least: float) -> dict[int, float]:
    """The 32-bit hashes whose prefixes all have an estimate of at least `least`, with their estimates."""
    live = np.arange(1 << LEVELS[0], dtype=np.int64)
    for level, bits in enumerate(LEVELS):
        if level:
            step = bits - LEVELS[level - 1]
            live = ((live[:, None] << step) + np.arange(1 << step, dtype=np.int64)).ravel()
        est = estimate(cells, level, live)
        keep = est >= least
        live, est = live[keep], est[keep]
    return dict(zip(live.tolist(), est.tolist(), strict=True))


def sketches(occurrences: DataFrame) -> DataFrame:
    """Partial sketches of (field STRING, item STRING): field, total, cells BINARY; at most one row for a field and task.

    Null items are not counted. To combine, add totals and cells, as merge() does.
    """
    hashed = occurrences.where(F.col("item").isNotNull() & F.col("field").isNotNull()).select("field", F.xxhash64("item").alias("h"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, tuple[np.ndarray, list[int]]] = {}
        for b in batches:
            coded = b.column(0).dictionary_encode()
            codes, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
            hashes = b.column(1).to_numpy(zero_copy_only=False)
            for i, name in enumerate(names):
                own = hashes if len(names) == 1 else hashes[codes == i]
                cells, total = made.setdefault(name, (np.zeros((len(LEVELS), DEPTH, WIDTH), np.int64), [0]))
                update(cells, own)
                total[0] += len(own)
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(list(made)), pa.array([t[0] for _, t in made.values()], pa.int64()), pa.array([c.tobytes() for c, _ in made.values()], pa.binary())], ["field", "total", "cells"])

    return hashed.mapInArrow(build, "field string, total bigint, cells binary")


def merge(parts: DataFrame, fan_in: int | None = None) -> DataFrame:
    """Adds up sketches of each field: in fan_in tasks first, then in one that reads what these leave. By default fan_in is
    the root of the number of shuffle partitions, at least 64, so neither step reads many more sketches a field than that.

    A task takes its sketches batch by batch and holds one of each field.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, tuple[np.ndarray, list[int]]] = {}
        for b in batches:
            for name, total, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                sums, count = made.setdefault(name, (np.zeros(CELLS, np.int64), [0]))
                sums += np.frombuffer(cells.as_buffer(), np.int64)
                count[0] += total
        for name, (sums, count) in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array(count, pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["field", "total", "cells"])

    schema = "field string, total bigint, cells binary"
    if fan_in is None:
        fan_in = max(64, math.isqrt(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return parts.repartition(fan_in).mapInArrow(add, schema).repartition(1).mapInArrow(add, schema)


def frequent_items(occurrences: DataFrame, share: float, again: DataFrame | None = None, slack: float = 0.5) -> DataFrame:
    """Values with at least `share` of the non-null occurrences of their field.

    occurrences has field, item STRING, one row for each occurrence; it is read twice, first for the sketch, then to count
    the candidates. again: the rows of the second scan with one more column, rid, that tells occurrences apart; rows equal
    in all three are one. It spares dropping copies of all rows a second time, as candidates are picked out first.
    Result: field, item, n (counted by the second scan), estimate (of the sketch), total. Ties are all kept; an empty
    table or a field with nulls only gives no rows; other columns are ignored. slack: part of the limit by which estimates
    may fall short and still be followed. The driver holds the sketches of the fields, one after the other, and about
    1 / (share * (1 - slack)) hashes a field at most; fields must be few.
    """
    spark = occurrences.sparkSession
    found = []
    for r in merge(sketches(occurrences)).toLocalIterator():
        cells = np.frombuffer(r["cells"], np.int64).reshape(len(LEVELS), DEPTH, WIDTH)
        found += [(r["field"], h, float(e), r["total"]) for h, e in descend(cells, share * (1 - slack) * r["total"]).items()]
    wanted = spark.createDataFrame(found, "field string, h32 bigint, estimate double, total bigint")
    low = F.xxhash64("item").bitwiseAND(F.lit(0xFFFFFFFF))
    rid = [] if again is None else ["rid"]
    hits = (occurrences if again is None else again).select("field", "item", *rid, low.alias("h32")).join(F.broadcast(wanted), ["field", "h32"])
    if rid:
        hits = hits.distinct()
    counted = hits.groupBy("field", "item", "estimate", "total").agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") >= F.col("total") * share).select("field", "item", "n", "estimate", "total")
