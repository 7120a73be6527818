"""Mixing sources to target weights by iterative proportional fitting.

Token sizes are summed over cells of source, language and topic. The cells are raked: scaled in turn to the marginals of
topics and languages and to the targets of the sources, no weight ever above its source's repeats, until nothing changes.
A source whose raked weights cannot bring it to its target is unmet. A document of a cell is then taken with the cell's
calibrated weight: its whole part as often, once more with the probability of the rest, decided by a hash of its id.

Sources are fitted last, so their targets hold as far as repeats allow; where caps or empty cells leave languages or topics
short, the report of all three marginals shows by how much, and whether the raking had settled.
"""

from __future__ import annotations

import base64
import importlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.terms import SPACES
from packetloom.plans.staging import stage

#: The tokenizer's ranks; a parameter, as the file is not part of this library.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pattern that splits a text before byte pairs are merged, as published with this vocabulary. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Cells of source, language and topic that the driver rakes by itself; more are raked as a table, by the same steps.
MOST_CELLS = 200_000
#: Raking ends when no weight changes by more, relative to the largest; after ROUNDS it is reported as not settled.
TOLERANCE, ROUNDS = 1e-9, 500


def source_key(source: Column) -> Column:
    """Sources are equal regardless of letter case and blanks around them."""
    return F.lower(F.btrim(source, F.lit(SPACES)))


#: The tokenizer a Python worker made last; its tasks share it.
_MADE: dict[str, object] = {}


def _encoder(ranks: str):
    if ranks not in _MADE:
        tiktoken = importlib.import_module("tiktoken")
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _MADE.clear()
        _MADE[ranks] = tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    return _MADE[ranks]


def with_tokens(documents: DataFrame, ranks: str = RANKS) -> DataFrame:
    """documents' columns but text, with n_tokens BIGINT: the tokens of text, 0 for a null one."""
    kept = [f for f in documents.schema.fields if f.name not in ("text", "n_tokens")]
    names = [f.name for f in kept]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks)
        for b in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in b.column(len(names)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], n], [*names, "n_tokens"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "n_tokens bigint"])
    return documents.select(*names, "text").mapInArrow(count, schema)


class Raked(NamedTuple):
    weights: np.ndarray
    rounds: int
    settled: bool


def capped(sizes: np.ndarray, w: np.ndarray, group: np.ndarray, cap: np.ndarray, want: np.ndarray) -> np.ndarray:
    """w scaled within each group so that sizes sum to what it wants and no weight is above its cap, or all are at it."""
    n = len(want)
    most = cap[group]
    fixed = (want >= cap * np.bincount(group, sizes, n))[group]
    out = np.where(fixed, most, w)
    while True:
        free = np.bincount(group, np.where(fixed, 0.0, out * sizes), n)
        rest = want - np.bincount(group, np.where(fixed, most * sizes, 0.0), n)
        out = np.where(fixed, most, out * np.where(free > 0, rest / np.where(free > 0, free, 1), 1.0)[group])
        over = (out > most) & ~fixed
        if not over.any():
            return out
        fixed |= over


def rake(sizes: np.ndarray, marginals: list[tuple[np.ndarray, np.ndarray]], cap: np.ndarray | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> Raked:
    """Weights of cells that bring their sizes to the wanted sums. marginals: group of each cell, wanted sum of each group.

    The first marginal is fitted last, within the caps of its groups, so it holds as far as they allow. Groups without any
    size can't be reached and are left out.
    """
    w = np.ones(len(sizes))
    for done in range(1, rounds + 1):
        before = w
        for group, want in reversed(marginals[1:]):
            have = np.bincount(group, w * sizes, len(want))
            w = w * np.where(have > 0, want / np.where(have > 0, have, 1), 1.0)[group]
        group, want = marginals[0]
        w = capped(sizes, w, group, np.full(len(want), np.inf) if cap is None else cap, want)
        if np.max(np.abs(w - before), initial=0) <= tolerance * max(1.0, np.max(w, initial=0)):
            return Raked(w, done, True)
    return Raked(w, rounds, False)


class Mixture(NamedTuple):
    """weights: k, lang, topic, w of every cell. marginals: marginal, value, size, target and planned (sizes) of every
    source, language and topic. sources: the target rows with size, target, planned and met. settled: whether the raking
    came to rest, in so many rounds."""

    weights: DataFrame
    marginals: DataFrame
    sources: list[dict]
    settled: bool
    rounds: int




def _targets(targets: DataFrame) -> tuple[list[dict], dict[str, tuple[float, float]]]:
    """The target rows, and share and repeats of each source: shares of equal sources add up, the most repeats hold."""
    listed = [r.asDict() for r in targets.select("source", source_key(F.col("source")).alias("k"), F.coalesce("target_share", F.lit(0.0)).alias("target_share"), F.coalesce("max_repeats", F.lit(0)).alias("max_repeats")).toLocalIterator()]
    of: dict[str, tuple[float, float]] = {}
    for r in listed:
        if r["k"] is not None:
            share, repeats = of.get(r["k"], (0.0, 0.0))
            of[r["k"]] = share + r["target_share"], max(repeats, float(r["max_repeats"]))
    return listed, of


def plan_mixture(sized: DataFrame, targets: DataFrame, most_cells: int = MOST_CELLS) -> Mixture:
    """Raked weights of all cells and what they come to.

    sized: source, lang, topic, n_tokens. A source's target is its share of the size of all listed documents; it is unmet
    if its raked weights, none above max_repeats, come to less; it then gives all it may. Languages and topics are to keep
    their shares among listed documents. Null shares or repeats count as 0; rows without a source, or whose source isn't
    listed, don't take part. The list of targets is a small table, which the driver holds.
    """
    spark = sized.sparkSession
    listed, of = _targets(targets)
    wanted = spark.createDataFrame([(k,) for k in sorted(of)], "k string")
    cells = stage(sized.withColumn("k", source_key(F.col("source"))).join(wanted, "k").groupBy("k", "lang", "topic").agg(F.sum(F.coalesce("n_tokens", F.lit(0))).cast("double").alias("n")), "cells")
    have = {r["k"]: r["n"] for r in cells.groupBy("k").agg(F.sum("n").alias("n")).collect()}
    total = sum(have.values())
    reach = {k: min(share * total, repeats * have.get(k, 0.0)) for k, (share, repeats) in of.items()}
    few = cells.limit(most_cells + 1).count() <= most_cells
    weights, rounds, settled = (_rake_here if few else _rake_table)(cells, of, reach, total)
    met = cells.join(weights, (F.col("k") == F.col("__k")) & F.col("lang").eqNullSafe(F.col("__lang")) & F.col("topic").eqNullSafe(F.col("__topic")))
    sums = []
    for name in ("k", "lang", "topic"):
        sums.append(met.groupBy(F.col(name).alias("value")).agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.col("w")).alias("planned")).select(F.lit("source" if name == "k" else name).alias("marginal"), "*"))
    got = {r["value"]: r["planned"] for r in sums[0].collect()}
    part = sum(reach.values()) / total if total else 0.0
    goal = spark.createDataFrame([(k, share * total) for k, (share, _) in of.items()], "value string, goal double")
    natural = sums[1].unionByName(sums[2]).withColumn("target", F.col("size") * part)
    own = sums[0].join(goal, "value").withColumnRenamed("goal", "target")
    marginals = own.unionByName(natural).select("marginal", "value", "size", "target", "planned")
    sources = []
    for r in listed:
        k = r["k"]
        goal_ = r["target_share"] * total
        # of rows that name the same source, each is judged by its own share and repeats
        planned = min(got.get(k, 0.0), r["max_repeats"] * have.get(k, 0.0)) if k is not None else 0.0
        sources.append({"source": r["source"], "target_share": r["target_share"], "size": int(have.get(k, 0.0)), "target": goal_, "planned": planned, "met": planned >= goal_ * (1 - 1e-6)})
    return Mixture(weights.select(F.col("__k").alias("k"), F.col("__lang").alias("lang"), F.col("__topic").alias("topic"), "w"), marginals, sources, settled, rounds)


_WEIGHTS = "__k string, __lang string, __topic string, w double"


def _rake_here(cells: DataFrame, of: dict, reach: dict, total: float) -> tuple[DataFrame, int, bool]:
    rows = sorted(((r["k"], r["lang"], r["topic"], r["n"]) for r in cells.collect()), key=lambda c: tuple(str(x) for x in c[:3]))
    sizes = np.array([r[3] for r in rows], float)
    names = sorted(of)
    part = sum(reach.values()) / total if total else 0.0
    marginals = []
    for column in range(3):
        values = names if column == 0 else list(dict.fromkeys(r[column] for r in rows))
        at = {v: i for i, v in enumerate(values)}
        group = np.array([at[r[column]] for r in rows], int)
        marginals.append((group, np.array([reach[k] for k in names]) if column == 0 else np.bincount(group, sizes, len(values)) * part if rows else np.zeros(0)))
    raked = rake(sizes, marginals, np.array([of[k][1] for k in names])) if rows else Raked(np.zeros(0), 0, True)
    table = cells.sparkSession.createDataFrame([(*r[:3], float(x)) for r, x in zip(rows, raked.weights, strict=True)], _WEIGHTS)
    return table, raked.rounds, raked.settled


def _rake_table(cells: DataFrame, of: dict, reach: dict, total: float, rounds: int = ROUNDS, tolerance: float = 1e-6) -> tuple[DataFrame, int, bool]:
    """The same steps with cells as a table, written after each round: the driver holds sources only."""
    spark = cells.sparkSession
    part = sum(reach.values()) / total if total else 0.0
    limits = spark.createDataFrame([(k, reach[k], of[k][1]) for k in sorted(of)], "k string, reach double, cap double")
    at = stage(cells.join(F.broadcast(limits), "k").withColumn("w", F.lit(1.0)), "raked")  # one row a listed source
    for done in range(1, rounds + 1):
        now = at.withColumnRenamed("w", "before").withColumn("w", F.col("before"))
        for name in ("topic", "lang"):
            sums = now.groupBy(F.col(name).alias("__v")).agg((F.sum("n") * part / F.sum(F.col("n") * F.col("w"))).alias("__f"))
            now = now.join(sums, F.col(name).eqNullSafe(F.col("__v"))).withColumn("w", F.col("w") * F.coalesce("__f", F.lit(1.0))).drop("__v", "__f")
        now = stage(now.withColumn("fixed", F.lit(False)), "raked")
        while True:  # scale each source within its cap, as capped() does
            held = F.when(F.col("fixed"), F.col("cap") * F.col("n")).otherwise(0.0)
            sums = now.groupBy("k").agg(F.sum("n").alias("__n"), F.sum(F.when(F.col("fixed"), 0.0).otherwise(F.col("w") * F.col("n"))).alias("__free"), F.sum(held).alias("__held"))
            x = now.join(F.broadcast(sums), "k").withColumn("fixed", F.col("fixed") | (F.col("reach") >= F.col("cap") * F.col("__n")))
            scaled = F.when(F.col("fixed"), F.col("cap")).otherwise(F.col("w") * F.coalesce(F.when(F.col("__free") > 0, (F.col("reach") - F.col("__held")) / F.col("__free")), F.lit(1.0)))
            x = x.withColumn("w", scaled).withColumn("over", (F.col("w") > F.col("cap")) & ~F.col("fixed"))
            x = stage(x.withColumn("fixed", F.col("fixed") | F.col("over")).drop("__n", "__free", "__held"), "raked")
            now = x.drop("over")
            if x.where("over").isEmpty():
                break
        change, most = now.agg(F.max(F.abs(F.col("w") - F.col("before"))), F.max("w")).collect()[0]
        at = now.select("k", "lang", "topic", "n", "reach", "cap", "w")
        if (change or 0.0) <= tolerance * max(1.0, most or 0.0):
            break
    else:
        return at.select(F.col("k").alias("__k"), F.col("lang").alias("__lang"), F.col("topic").alias("__topic"), "w"), rounds, False
    return at.select(F.col("k").alias("__k"), F.col("lang").alias("__lang"), F.col("topic").alias("__topic"), "w"), done, True


def take(sized: DataFrame, weights: DataFrame, seed: int = 17) -> DataFrame:
    """sized with copies INT, how often each document is taken; documents taken no time are left out."""
    table = weights.select(F.col("k").alias("__k"), F.col("lang").alias("__lang"), F.col("topic").alias("__topic"), F.col("w").alias("__w"))
    cond = (source_key(F.col("source")) == F.col("__k")) & F.col("lang").eqNullSafe(F.col("__lang")) & F.col("topic").eqNullSafe(F.col("__topic"))
    # Spark's own size check decides how to join; cells are few beside documents
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    copies = (F.floor("__w") + F.when(drawn < F.col("__w") - F.floor("__w"), 1).otherwise(0)).cast("int")
    return sized.join(table, cond).withColumn("copies", copies).drop("__k", "__lang", "__topic", "__w").where("copies > 0")
