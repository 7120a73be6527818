"""Distinct identifiers for groups and combinations of groups by hash-range decomposition.

The pair of an identifier and the keys common to all combinations falls into one of `buckets` disjoint hash ranges, and
rows are partitioned by that range alone. Within a bucket pairs are deduplicated, each with the set of members it was seen
in, so every combination of members is counted exactly there, without another shuffle; counts of buckets add up. The error
is 0. As the pair and not the identifier alone is hashed, an identifier seen with very many groups is spread over all
buckets, and pairs that hold many rows are reduced to one before they are moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: More than a cluster has tasks at once, so that buckets never bound how wide it runs.
BUCKETS = 1 << 16
MOST_MEMBERS = 62
#: Rows deduplicated together before they are moved; any number gives the same result.
_HELD = 1 << 19


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct rows of each stretch of _HELD rows."""
    held, n = [], 0

    def once() -> list[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        return t.group_by(t.column_names, use_threads=False).aggregate([]).to_batches()

    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= _HELD:
            yield from once()
            held, n = [], 0
    if n:
        yield from once()


def pairs(rows: DataFrame, ident: str, keys: list[str], member: Column, members: list, buckets: int = BUCKETS, within: tuple[int, int] | None = None) -> DataFrame:
    """The mergeable partial result: bucket, keys, ident, mask (bit i: seen with members[i]), partitioned by bucket.

    Partial results of other days or files are merged with merge_pairs(). Rows with a null identifier, a null key or a
    member not listed don't count. within: only buckets low <= bucket < high; where all of them at once are more than the
    cluster can hold, ranges are taken one after the other and their counts added by add_counts().
    """
    if not 0 < len(members) <= MOST_MEMBERS:
        raise ValueError(f"1 to {MOST_MEMBERS} members")
    bit = F.lit(None).cast("bigint")
    for i, m in reversed(list(enumerate(members))):
        bit = F.when(member == F.lit(m), F.lit(1 << i).cast("bigint")).otherwise(bit)
    kept = rows.select(*keys, ident, bit.alias("mask")).where(F.col("mask").isNotNull() & F.col(ident).isNotNull())
    for k in keys:
        kept = kept.where(F.col(k).isNotNull())
    bucket = F.pmod(F.xxhash64(ident, *keys), F.lit(buckets)).cast("int").alias("bucket")
    kept = kept.mapInArrow(_combined, kept.schema).select(bucket, *keys, ident, "mask")
    if within:
        kept = kept.where((F.col("bucket") >= within[0]) & (F.col("bucket") < within[1]))
    return kept.repartition("bucket").groupBy("bucket", *keys, ident).agg(F.bit_or("mask").alias("mask"))


def merge_pairs(parts: list[DataFrame], ident: str, keys: list[str]) -> DataFrame:
    """One partial result of several made with the same members and number of buckets."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.repartition("bucket").groupBy("bucket", *keys, ident).agg(F.bit_or("mask").alias("mask"))


def bucket_counts(partial: DataFrame, keys: list[str], members: list, combinations: dict[str, list]) -> DataFrame:
    """bucket, keys and n_<label> for every combination, counted within each bucket without moving a row."""
    masks = {label: sum(1 << members.index(m) for m in set(which)) for label, which in combinations.items()}
    sums = [F.sum(F.when(F.col("mask").bitwiseAND(F.lit(m)) != 0, 1).otherwise(0)).alias(f"n_{label}") for label, m in masks.items()]
    return partial.groupBy("bucket", *keys).agg(*sums)


def add_counts(parts: list[DataFrame], keys: list[str], combinations: dict[str, list]) -> DataFrame:
    """keys, combination STRING, n_distinct > 0: the counts of buckets added up. Each bucket must be in one part only."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    wide = out.groupBy(*keys).agg(*[F.sum(F.col(f"`n_{label}`")).alias(f"n_{label}") for label in combinations])
    each = F.explode(F.array(*[F.struct(F.lit(label).alias("combination"), F.col(f"`n_{label}`").alias("n_distinct")) for label in combinations]))
    return wide.select(*keys, each.alias("__x")).select(*keys, "__x.combination", "__x.n_distinct").where(F.col("n_distinct") > 0)


def distinct_counts(partial: DataFrame, keys: list[str], members: list, combinations: dict[str, list]) -> DataFrame:
    """keys, combination STRING, n_distinct for every combination (label: members) that has any identifier."""
    return add_counts([bucket_counts(partial, keys, members, combinations)], keys, combinations)
