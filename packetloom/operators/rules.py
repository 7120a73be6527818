"""Many rules against traffic at once, in one pass over the rows.

Rules are found by what they ask for: each conjunction that compares a field for equality is listed under one of its
literals, the one that fewest others share, and a row looks up its own value of that field in a hash table. What is listed
there is data, not code: its other comparisons are structs of a kind and values, decided by one expression that knows the
kinds, so a thousand rules cost a row no more than the few listed under its values. Rules without any equality are decided
one by one in the same pass. Prefixes of addresses are found by their own bits.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.filterlang import Filter
from packetloom.filterlang import fields as R
from packetloom.filterlang.ast import IntRange, Net, Op, Predicate
from packetloom.filterlang.compile import operand
from packetloom.filterlang.errors import InvalidPredType
from packetloom.filterlang.regexes import to_jvm

#: Bytes of rules that are broadcast; more are joined as Spark sees fit.
BROADCAST_BYTES = 64 << 20


def _fits(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a table of rules are few and short enough to be broadcast, by their text's bytes."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in df.columns), F.lit(32))
    return (df.agg(F.sum(size)).collect()[0][0] or 0) <= most


@dataclass(frozen=True)
class Rule:
    """name is delivered with the rows that the filter lets through."""

    name: str
    filter: str


def match_values(rows: DataFrame, rules: DataFrame, column: Column) -> DataFrame:
    """rows with rule STRING for each rule (rule, value) whose value equals the column. Null equals nothing."""
    side = rules.select(F.col("rule"), F.col("value").alias("__value"))
    return rows.join(F.broadcast(side) if _fits(side) else side, column == F.col("__value")).drop("__value")


def match_prefixes(rows: DataFrame, nets: DataFrame, addr: str) -> DataFrame:
    """rows with the nets (rule STRING, low BIGINT, prefix INT) that hold the IPv4 number addr.

    An address is masked to each of the prefix lengths in use, at most 33, which makes an equi-join of a range join.
    """
    lengths = sorted(r[0] for r in nets.select("prefix").where("prefix between 0 and 32").distinct().collect())
    side = nets.select("rule", F.col("low").alias("__low"), F.col("prefix").alias("__prefix"))
    if not lengths:
        return rows.limit(0).withColumn("rule", F.lit(None).cast("string"))
    masks = F.array(*[F.struct(F.lit(n).alias("p"), F.col(addr).bitwiseAND(F.lit((0xFFFFFFFF << (32 - n)) & 0xFFFFFFFF).cast("bigint")).alias("low")) for n in lengths])
    keyed = rows.where(F.col(addr).isNotNull()).withColumn("__m", F.explode(masks))
    side = F.broadcast(side) if _fits(side) else side
    return keyed.join(side, (F.col("__m.p") == F.col("__prefix")) & (F.col("__m.low") == F.col("__low"))).drop("__m", "__low", "__prefix")


#: Fields that say little: few values, so equality with one finds half of all rows.
_POOR = frozenset(("ns", "cwr", "ece", "urg", "ack", "psh", "rst", "syn", "fin", "synack", "flags", "version", "protocol", "next_header", "data_offset", "ihl", "version_ihl"))
_PRED = "struct<k: int, s: string, lo: bigint, hi: bigint, b: binary, b2: binary>"


def _literal(p: Predicate) -> object | None:
    """The value that equality asks for, if rows can be found by it."""
    if p.unary or p.field in _POOR:
        return None
    if isinstance(p.value, Net):
        if p.op not in (Op.EQ, Op.IN) or p.value.low != p.value.high:
            return None
        return p.value.low if p.value.version == 4 else p.value.low.to_bytes(16, "big")
    if p.op is Op.EQ and isinstance(p.value, int | str) and (not isinstance(p.value, int) or p.value < 1 << 63):
        return p.value
    return None


def _as_data(p: Predicate) -> tuple | None:
    """What tells a predicate from others of its kind: (kind, s, lo, hi, b, b2); None if only an expression can say it."""
    v, op = p.value, p.op
    if p.unary:
        return ((p.proto,), None, None, None, None, None)
    kind = (p.proto, p.field, op, type(v).__name__ + (str(v.version) if isinstance(v, Net) else ""))
    if isinstance(v, IntRange):
        return None if v.high >= 1 << 63 else (kind, None, v.low, v.high, None, None)
    if isinstance(v, int):
        return None if v >= 1 << 63 else (kind, None, v, None, None, None)
    if isinstance(v, Net):
        return (kind, None, v.low, v.high, None, None) if v.version == 4 else (kind, None, None, None, v.low.to_bytes(16, "big"), v.high.to_bytes(16, "big"))
    if isinstance(v, bytes):
        return (kind, None, None, None, v, None)
    text = to_jvm(v, op is Op.BYTE_RE) if op in (Op.RE, Op.BYTE_RE) else "".join(w[:1].upper() + w[1:] for w in v.split("_")) if op is Op.EN else v
    return (kind, text, None, None, None, None)


def _decided(p: Predicate, x: Column, stage: str, columns: list[str]) -> Column:
    """A predicate's kind on the values of the struct x."""
    layer, c, kind = operand(p, stage, columns)
    if c is None:
        return layer
    v, op = p.value, p.op
    if isinstance(v, IntRange | Net):
        inside = c.between(x["b"], x["b2"]) if isinstance(v, Net) and v.version == 6 else c.between(x["lo"], x["hi"])
        return layer & (~inside if op is Op.NE else inside)
    if isinstance(v, int):
        n = x["lo"]
        return layer & {Op.EQ: c == n, Op.NE: c != n, Op.GE: c >= n, Op.LE: c <= n, Op.GT: c > n, Op.LT: c < n}[op]
    if op is Op.RE:
        return layer & F.rlike(c, x["s"])
    if op is Op.BYTE_RE:
        return layer & F.rlike(F.decode(c if kind == R.BYTES else c.cast("binary"), "ISO-8859-1"), x["s"])
    data, value = (c.cast("binary") if kind == R.TEXT else c, x["b"]) if isinstance(v, bytes) else (c, x["s"])
    return layer & {Op.EQ: data == value, Op.EN: data == value, Op.NE: data != value, Op.CONTAINS: F.contains(data, value), Op.NOT_CONTAINS: ~F.contains(data, value)}[op]


def match_filters(rows: DataFrame, rules: list[Rule], stage: str = "packet") -> DataFrame:
    """rows with rule STRING for each rule whose filter lets them through; a row may come with several rules.

    stage is packet, connection or session. Identical filters are decided once. Rows come through once, whatever the number
    of rules; an empty list of rules gives no rows. A column rule is replaced; columns that begin with two underscores must not be among the rows'.
    """
    by_text: dict[str, list[str]] = {}
    for r in rules:
        by_text.setdefault(r.filter, []).append(r.name)
    filters = {text: Filter(text) for text in by_text}
    shared: Counter = Counter()
    for f in filters.values():
        if stage == "packet" and f.stage() != "packet" or stage == "connection" and f.stage() == "session":
            raise InvalidPredType(f"not decided at this stage: {f.text}")
        if stage != "packet":
            f.require_connection()
        shared.update({(p.proto, p.field, v) for q in f.patterns for p in q if (v := _literal(p)) is not None})
    kinds: dict[tuple, tuple[int, Predicate]] = {}
    listed: dict[tuple, dict[object, list[tuple]]] = defaultdict(lambda: defaultdict(list))
    direct: list[str] = []
    for text, f in filters.items():
        found = []
        for q in f.patterns:
            data = [(p, _as_data(p)) for p in q if p.proto != "ethernet"]
            keys = [(shared[p.proto, p.field, v], p.key, p, v) for p in q if (v := _literal(p)) is not None]
            if not keys or any(x is None for _, x in data):
                break
            found.append((min(keys, key=lambda k: k[:2]), data))
        else:
            for (_, _, anchor, value), data in found:
                for p, x in data:
                    kinds.setdefault(x[0], (len(kinds), p))
                listed[anchor.proto, anchor.field, anchor][value].append((by_text[text], [(kinds[x[0]][0], *x[1:]) for _, x in data]))
            continue
        direct.append(text)
    # fields of the same name are one table, whatever the predicate that stands for it
    tables: dict[tuple, tuple[Predicate, dict[object, list[tuple]]]] = {}
    for (proto, name, p), values in listed.items():
        have = tables.setdefault((proto, name), (p, defaultdict(list)))[1]
        for v, found in values.items():
            have[v] += found
    spark, columns, out, lists = rows.sparkSession, rows.columns, rows, []
    for i, (p, values) in enumerate(tables.values()):
        _, c, _ = operand(p, stage, columns)
        kind = {int: "bigint", str: "string", bytes: "binary"}[type(next(iter(values)))]
        side = spark.createDataFrame(list(values.items()), f"__key{i} {kind}, __found{i} array<struct<names: array<string>, preds: array<{_PRED}>>>")
        size = sum(64 + sum(len(n) for n in names) + 48 * len(preds) for found in values.values() for names, preds in found)
        out = out.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, c == F.col(f"__key{i}"), "left")
        lists.append(F.coalesce(f"__found{i}", F.expr(f"cast(array() as array<struct<names: array<string>, preds: array<{_PRED}>>>)")))
    marks = []
    if lists:

        def holds(x: Column) -> Column:
            cond = None
            for k, p in kinds.values():
                c = _decided(p, x, stage, columns)
                cond = F.when(x["k"] == k, c) if cond is None else cond.when(x["k"] == k, c)
            return F.coalesce(cond, F.lit(False))

        met = F.filter(F.concat(*lists), lambda x: F.forall(x["preds"], holds))
        marks.append(F.flatten(F.transform(met, lambda x: x["names"])))
    each = []
    for text in direct:
        f = filters[text]
        cond = f.on_packets(columns, exact=True) if stage == "packet" else f.on_connections() if stage == "connection" else f.on_sessions()
        each.append(F.when(cond, F.array(*[F.lit(n) for n in by_text[text]])))
    if each:
        marks.append(F.flatten(F.filter(F.array(*each), lambda x: x.isNotNull())))
    if not marks:
        return rows.withColumn("rule", F.lit(None).cast("string")).limit(0)
    return out.select(*[c for c in rows.columns if c != "rule"], F.explode(F.array_distinct(F.concat(*marks))).alias("rule"))
