"""Percentiles per group by radix selection on order-preserving integers.

A floating value is mapped to the integer of the same order that its bits make; an integer is its own. The first digit is
the leading bits of the value's floating form, sign, exponent and some bits of the mantissa. Histograms of that digit are
small, add up over partitions and days, and bound any percentile within a relative error of 2^-bits. Selection follows only
the cell that contains the target rank: its values are counted by their next DIGIT_BITS bits within the cell's own range,
until every cell holds a single value. The result is then exact.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType

from packetloom.plans.staging import stage

#: Mantissa bits of the first digit: of histograms that are kept, and of the first pass of a selection, where fewer make
#: less to move and leave more for the next pass.
BITS, FIRST_BITS, DIGIT_BITS = 8, 3, 16
_TOP = (1 << 63) - 1
_NAN = int(np.float64("nan").view(np.int64))


def _bits(v: pd.Series) -> pd.Series:
    """The bits of floating values as integers of the same order. -0.0 is 0.0; NaN is above all else."""
    x = v.to_numpy(np.float64) + 0.0
    b = np.where(np.isnan(x), np.float64("nan"), x).view(np.int64)
    return pd.Series(np.where(b < 0, b ^ _TOP, b))


def _floats(v: pd.Series) -> pd.Series:
    """The floating values of what _bits() gives."""
    b = v.to_numpy(np.int64)
    return pd.Series(np.where(b < 0, b ^ _TOP, b).view(np.float64))


def _is_floating(kind: DataType) -> bool:
    if isinstance(kind, DoubleType | FloatType):
        return True
    if isinstance(kind, LongType | IntegerType | ShortType | ByteType):
        return False
    raise TypeError(f"percentiles of {kind.simpleString()}: cast to DOUBLE or BIGINT")


def ordered(value: Column, kind: DataType) -> Column:
    """BIGINT of the same order as a floating or integer value; null stays null."""
    if not _is_floating(kind):
        return value.cast("bigint")
    return F.when(value.isNotNull(), pandas_udf(_bits, "bigint")(F.coalesce(value.cast("double"), F.lit(0.0))))


def _size(key: Column) -> Column:
    return F.abs(F.greatest(key, F.lit(-_TOP)))


def _exponent(key: Column) -> Column:
    """Place of the highest bit of an integer's absolute value, 0 for 0 and 1."""
    return F.length(F.bin(_size(key))) - 1


def first_digit(key: Column, floating: bool = False, bits: int = BITS, exponent: Column | None = None) -> Column:
    """Order-preserving leading bits of the floating form of what ordered() gives. exponent: _exponent(key), if at hand."""
    if floating:
        return F.shiftright(key, 52 - bits)  # the key has the floating form already
    over = (_exponent(key) if exponent is None else exponent) - bits
    cell = F.when(_size(key) < (1 << bits), _size(key)).otherwise(over * (1 << bits) + F.call_function("shiftright", _size(key), over))
    return F.when(key < 0, -cell - 1).otherwise(cell).cast("bigint")


def _cells(v: DataFrame, ks: list[str], floating: bool, bits: int) -> DataFrame:
    """ks, digit, n, low, high of rows with __v. The exponent is a column of its own, so it is computed once a value."""
    if not floating:
        v = v.withColumn("__e", _exponent(F.col("__v")))
    digit = first_digit(F.col("__v"), floating, bits, None if floating else F.col("__e"))
    return v.groupBy(*ks, digit.alias("digit")).agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))


def _keyed(values: DataFrame, keys: list[str], more: list[str] | None = None) -> tuple[DataFrame, bool]:
    """__k0, __k1, ... for the keys, __v, the ordered integer of value, and the columns more; nulls left out."""
    kind = values.schema["value"].dataType
    cols = [F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
    return values.where(F.col("value").isNotNull()).select(*cols, *(more or []), ordered(F.col("value"), kind).alias("__v")), _is_floating(kind)


def histogram(values: DataFrame, keys: list[str], bits: int = BITS) -> DataFrame:
    """The mergeable partial result: keys, digit, n, low, high (the least and greatest value of the cell).

    values has keys and value, BIGINT or DOUBLE (or of a smaller kind); null values don't count, null keys form a group of
    their own. Histograms of floating and of integer values are not to be merged.
    """
    v, floating = _keyed(values, keys)
    out = _cells(v, [f"__k{i}" for i in range(len(keys))], floating, bits)
    return _restored(out.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)], "digit", "n", "low", "high"), ["low", "high"], floating)


def _restored(df: DataFrame, columns: list[str], floating: bool) -> DataFrame:
    # pandas would make null of NaN
    return df.withColumns({c: F.when(F.col(c) == _NAN, F.lit(float("nan"))).otherwise(pandas_udf(_floats, "double")(c)) for c in columns}) if floating else df


def merge_histograms(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys, "digit").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def _target(cells: DataFrame, keys: list[str], rank: Column) -> DataFrame:
    """The cell of each group in which the rank lies, with the count before it."""
    before = F.sum("n").over(W.partitionBy(*keys).orderBy("digit").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
    c = cells.withColumn("before", before)
    return c.where((rank > F.col("before")) & (rank <= F.col("before") + F.col("n")))


def locate(cells: DataFrame, keys: list[str], quantiles: dict[str, tuple[int, int]], by: str | None = None) -> DataFrame:
    """Cells of the wanted ranks: keys, q, total, rank (within the cell), low, high, n.

    quantiles: share as (numerator, denominator) for each label, all of them for every group; with `by`, the label is
    the value of that key and the group gets only its own.
    """
    totals = cells.withColumn("total", F.sum("n").over(W.partitionBy(*keys)))
    wanted = F.array(*[F.struct(F.lit(label).alias("q"), F.lit(num).cast("bigint").alias("num"), F.lit(den).cast("bigint").alias("den")) for label, (num, den) in quantiles.items()])
    t = totals.withColumn("__w", F.explode(wanted)).select("*", "__w.q", "__w.num", "__w.den").drop("__w")
    if by:
        t = t.where(F.col("q") == F.col(by))
    least = F.greatest(F.lit(1), F.expr("(total * num + den - 1) div den"))
    found = _target(t.withColumn("rank0", least), [*keys, "q"], F.col("rank0"))
    return found.select(*keys, "q", "total", (F.col("rank0") - F.col("before")).alias("rank"), "low", "high", "n")


def percentiles(values: DataFrame, keys: list[str], quantiles: dict[str, tuple[int, int]], by: str | None = None, again: DataFrame | None = None) -> DataFrame:
    """Exact percentiles: keys, q, value, total. The percentile q is the least value with at least the share q of the
    values not above it. A group without values has no row; null values don't count, null keys form a group of their own.

    values is read twice: for the first histogram, and for the values of the cells it leaves open, which alone are written
    and read again by later passes. again: the rows of the second reading, with one more column, rid, that tells
    occurrences apart; rows equal in all of these are one. It spares dropping copies of all rows a second time, as the
    cells' values are picked out first. Keys must not be called value, rid, q or total; other columns are ignored.
    """
    ks = [f"__k{i}" for i in range(len(keys))]
    v, floating = _keyed(values, keys)
    at = stage(locate(_cells(v, ks, floating, FIRST_BITS), ks, quantiles, ks[keys.index(by)] if by else None), "radix")
    done: list[DataFrame] = []
    rest: DataFrame | None = None  # the values of open cells, once they are written
    while True:
        done.append(at.where("low = high").select(*ks, "q", F.col("low").alias("value"), "total"))
        open_ = at.where("low < high")
        if open_.isEmpty():
            break
        # digits of the cell's own range: the shift leaves DIGIT_BITS of it; a range wider than BIGINT is taken by its halves
        width = F.length(F.bin(F.expr("cast(high as decimal(20,0)) - cast(low as decimal(20,0))").cast("bigint")))
        wide = F.expr("cast(high as decimal(20,0)) - cast(low as decimal(20,0)) > 9223372036854775807")
        cell = open_.select(*[F.col(k).alias(f"{k}c") for k in ks], "q", "total", "rank", "low", "high", F.when(wide, 64 - DIGIT_BITS).otherwise(F.greatest(F.lit(0), width - DIGIT_BITS)).cast("int").alias("shift"))
        cond = F.col("__v").between(F.col("low"), F.col("high"))
        for k in ks:
            cond = cond & F.col(k).eqNullSafe(F.col(f"{k}c"))
        if rest is None:
            more = ["rid"] if again is not None else []
            source = _keyed(again, keys, more)[0] if again is not None else v
            met = source.join(cell.select(*[f"{k}c" for k in ks], "low", "high").distinct(), cond).select(*ks, *more, "__v")
            rest = stage((met.distinct() if more else met).select(*ks, "__v"), "open")
        digit = F.expr("case when shift = 48 then shiftright(__v, 48) - shiftright(low, 48) else shiftright(__v - low, shift) end")
        inside = rest.join(cell, cond).select(*ks, "q", "total", "rank", digit.alias("digit"), "__v")
        counted = inside.groupBy(*ks, "q", "total", "rank", "digit").agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
        at = stage(_target(counted, [*ks, "q"], F.col("rank")).select(*ks, "q", "total", (F.col("rank") - F.col("before")).alias("rank"), "low", "high", "n"), "radix")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    out = _restored(out, ["value"], floating)
    return out.select(*[F.col(k).alias(name) for k, name in zip(ks, keys, strict=True)], "q", "value", "total")


def percentile_bounds(cells: DataFrame, keys: list[str], quantiles: dict[str, tuple[int, int]], by: str | None = None) -> DataFrame:
    """Percentiles from histograms alone: keys, q, low, high, total; the percentile lies between low and high."""
    return locate(cells, keys, quantiles, by).select(*keys, "q", "low", "high", "total")
