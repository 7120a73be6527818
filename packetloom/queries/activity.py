"""Queries of problems 4 and 5: sessions of activity, and keys that hold most records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.functions.addresses import endpoint_address
from packetloom.operators.sessions import sessionize
from packetloom.operators.skew import balanced_aggregate, balanced_join, plan_placement
from packetloom.sources.tables import micros, table

IDLE_US = 30 * 60 * 1_000_000


def _sides(conns: DataFrame, *extra: str) -> DataFrame:
    """One row for each end of a connection: side, device, and the columns named."""
    tup = F.col("five_tuple")
    known = conns.select(*extra, endpoint_address(tup["orig"]).alias("__o"), endpoint_address(tup["resp"]).alias("__r"))
    both = F.array(F.struct(F.lit("orig").alias("side"), F.col("__o").alias("device")), F.struct(F.lit("resp").alias("side"), F.col("__r").alias("device")))
    return known.select(*extra, F.explode(both).alias("__x")).select(*extra, "__x.side", "__x.device")


def _timed(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "connections").select("conn_id", "five_tuple", micros("start_ts").alias("s"), micros("last_ts").alias("e"))
    return _sides(c, "conn_id", "s", "e")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    # copies of a connection change neither start nor end of a session, so they need not be dropped here
    return sessionize(_timed(spark, d), ["side", "device"], "s", "e", IDLE_US).select("side", "device", "start_us", "end_us")


def p4_sessions(spark: SparkSession, d: str) -> DataFrame:
    out = sessionize(_timed(spark, d), ["side", "device"], "s", "e", IDLE_US, count_id=["conn_id"])
    return out.withColumnRenamed("n_events", "n_connections")


_DEVICE = "case when a like '::ffff:%.%' then substr(a, 8) else a end"
_SIDES_SQL = f"""
sides as (select conn_id, s, e, side, {_DEVICE} as device from (
  select conn_id, epoch_us(start_ts) s, epoch_us(last_ts) e, side,
    lower(case when p like '[%' then regexp_extract(p, '^\\[([^\\]]*)\\]', 1) else regexp_replace(p, ':[^:]*$', '') end) a
  from (select conn_id, start_ts, last_ts, 'orig' side, five_tuple.orig p from connections
        union all select conn_id, start_ts, last_ts, 'resp', five_tuple.resp from connections))
  where a is not null and a <> '')"""
_SESSIONS_SQL = f"""
with {_SIDES_SQL},
one as (select distinct conn_id, side, device, s, greatest(s, coalesce(e, s)) e from sides where s is not null),
run as (select *, max(e) over (partition by side, device order by s, e rows between unbounded preceding and 1 preceding) before from one),
marked as (select *, sum(case when before is null or s - before > {IDLE_US} then 1 else 0 end) over (partition by side, device order by s, e rows unbounded preceding) no from run)
select side, device, min(s) start_us, max(e) end_us, max(e) - min(s) duration_us, count(*)::bigint n_connections from marked group by side, device, no
"""


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """field, addr, id, t of every row of connections and packets, copies included."""
    conns = _sides(table(spark, d, "connections").select("conn_id", "five_tuple", micros("start_ts").alias("t")), "conn_id", "t")
    ends = conns.select(F.col("side").alias("field"), F.col("device").alias("addr"), F.col("conn_id").alias("id"), "t")
    packets = table(spark, d, "packets").select(F.lit("src_addr").alias("field"), F.col("src_addr").cast("string").alias("addr"), F.col("pkt_id").cast("string").alias("id"), micros("ts").alias("t"))
    return ends.unionByName(packets).where(F.col("addr").isNotNull())


_FIELD = ["field", "addr"]


def p5_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Every address with its number of records and its share in the field."""
    rows = _rows(spark, d)
    # loads are estimated on rows as they are, copies included, which hardly change who is heavy
    per = balanced_aggregate(rows, _FIELD, {"n": F.count(F.lit(1))}, {"n_records": F.sum("n")}, ["id"], plan_placement(rows, _FIELD), once=True)
    totals = per.groupBy("field").agg(F.sum("n_records").alias("n_field"))
    return per.join(F.broadcast(totals), "field")  # one row for each of three fields


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_addresses(spark, d).where(F.col("n_records") * 100 >= F.col("n_field") * 3).select("field", "addr")


def p5_first_hour(spark: SparkSession, d: str) -> DataFrame:
    """Of each address, the records within an hour after its first: every record meets its address's row in a join."""
    rows = _rows(spark, d)
    plan = plan_placement(rows, _FIELD)
    rec = rows.distinct()
    first = balanced_aggregate(rec, _FIELD, {"t": F.min("t")}, {"first_us": F.min("t")}, ["id"], plan)
    met = balanced_join(rec, first, _FIELD, ["id"], placement=plan)
    early = F.when(F.col("t") - F.col("first_us") <= 3_600_000_000, 1).otherwise(0)
    return met.groupBy(*_FIELD).agg(F.min("first_us").alias("first_us"), F.sum(early).alias("n_first_hour"), F.count(F.lit(1)).alias("n_records"))


_RECORDS_SQL = f"""
with {_SIDES_SQL},
rec as (select distinct side field, device addr, conn_id id, s t from sides
  union all select distinct 'src_addr', src_addr::varchar, pkt_id::varchar, epoch_us(ts) from packets where src_addr is not null)"""

QUERIES = {"p4_found": p4_found, "p4_sessions": p4_sessions, "p5_found": p5_found, "p5_addresses": p5_addresses, "p5_first_hour": p5_first_hour}
SQL = {
    "p4_found": f"select side, device, start_us, end_us from ({_SESSIONS_SQL})",
    "p4_sessions": _SESSIONS_SQL,
    "p5_addresses": f"{_RECORDS_SQL} select field, addr, count(*)::bigint n_records, sum(count(*)) over (partition by field)::bigint n_field from rec group by field, addr",
    "p5_found": f"{_RECORDS_SQL} select field, addr from (select field, addr, count(*) n, sum(count(*)) over (partition by field) m from rec group by field, addr) where n * 100 >= m * 3",
    "p5_first_hour": f"""{_RECORDS_SQL}, f as (select field, addr, t, min(t) over (partition by field, addr) first_us from rec)
select field, addr, first_us, sum(case when t - first_us <= 3600000000 then 1 else 0 end)::bigint n_first_hour, count(*)::bigint n_records from f group by field, addr, first_us""",
}
