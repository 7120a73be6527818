"""Queries of the problems tagged llm, each with the SQL it is compared with where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from packetloom.llm import distinct, heavy_hitters, leaks, mixing, percentiles, sentences, terms
from packetloom.plans.staging import stage
from packetloom.sources.tables import day, table

SHARE = 0.01
MIN_SOURCES = 30
LIMITS = {"byte_count_p90": (90, 100, 1_000_000), "pkt_count_p50": (50, 100, 20), "interarrivals_ctos_p50": (50, 100, 50_000_000)}


# Problem 1


def _packet_items(packets: DataFrame) -> DataFrame:
    items = F.array(F.struct(F.lit("dst_addr").alias("field"), F.col("a").cast("string").alias("item")), F.struct(F.lit("dst_port").alias("field"), F.col("p").cast("string").alias("item")))
    return packets.select("pkt_id", F.explode(items).alias("x")).select("x.field", "x.item", F.col("pkt_id").cast("string").alias("rid")).where(F.col("item").isNotNull())


def _name_items(dns: DataFrame) -> DataFrame:
    name = F.lower(F.regexp_replace("name", r"\.$", ""))
    return dns.select("session_id", F.posexplode("names").alias("pos", "name")).where(F.col("name").isNotNull()).select(F.lit("queries").alias("field"), name.alias("item"), F.concat_ws("/", "session_id", "pos").alias("rid"))


def p1_frequent(spark: SparkSession, d: str) -> DataFrame:
    """Values with a hundredth of the occurrences of their field: counted, estimated by the sketch, and the total."""
    packets = table(spark, d, "packets").select("pkt_id", F.col("dst_addr").alias("a"), F.when(F.col("proto") == 17, F.col("dst_port")).alias("p"))
    dns = table(spark, d, "dns_transactions").select("session_id", F.col("query.queries").alias("names"))
    once = _packet_items(packets.distinct()).unionByName(_name_items(dns.distinct()))
    return heavy_hitters.frequent_items(once, SHARE, again=_packet_items(packets).unionByName(_name_items(dns)))


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same with the sketch's estimate as what is known of it: that it lies within its error of the exact count."""
    off = F.abs(F.col("estimate") - F.col("n"))
    return p1_frequent(spark, d).select("field", "item", "n", "total", (off <= 3 * F.col("total") / heavy_hitters.WIDTH**0.5).alias("close"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_frequent(spark, d).select("field", "item")


_P1 = """
with pk as (select distinct pkt_id, dst_addr, dst_port, proto from packets),
dq as (select distinct session_id, query.queries names from dns_transactions),
occ as (select 'dst_addr' field, dst_addr::varchar item from pk where dst_addr is not null
  union all select 'dst_port', dst_port::varchar from pk where proto = 17 and dst_port is not null
  union all select 'queries', lower(regexp_replace(n, '\\.$', '')) from (select unnest(names) n from dq) where n is not null)
select field, item from (select field, item, count(*) n, sum(count(*)) over (partition by field) m from occ group by field, item) where n >= 0.01 * m
"""

_P1_COUNTS = _P1.rstrip().removesuffix("where n >= 0.01 * m").replace("select field, item from", "select field, item, n::bigint n, m::bigint total, true as close from") + " where n >= 0.01 * m"

# Problem 2

_P2_KEYS, _P2_MEMBERS, _P2_COMBINATIONS = ["day", "dst_addr"], [6, 17], {"6": [6], "17": [17], "*": [6, 17]}


def p2_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Destinations of a day with each of their sources, and the protocols it used (1: 6, 2: 17)."""
    return _pairs(spark, d).drop("bucket")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    packets = table(spark, d, "packets").select(day("ts").alias("day"), "dst_addr", "proto", "src_addr")
    return distinct.pairs(packets, "src_addr", _P2_KEYS, F.col("proto"), _P2_MEMBERS)


def p2_sources(spark: SparkSession, d: str) -> DataFrame:
    """Distinct sources of every destination, by day, for each protocol and for both."""
    return distinct.distinct_counts(_pairs(spark, d), _P2_KEYS, _P2_MEMBERS, _P2_COMBINATIONS).withColumnRenamed("combination", "proto")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_sources(spark, d).where(F.col("n_distinct") >= MIN_SOURCES).select("day", "dst_addr", "proto")


_P2 = """
select strftime(ts, '%Y-%m-%d') as day, dst_addr, case when grouping(proto) = 1 then '*' else proto::varchar end proto, count(distinct src_addr)::bigint n_distinct
from packets where dst_addr is not null and src_addr is not null and ts is not null and proto in (6, 17)
group by grouping sets ((strftime(ts, '%Y-%m-%d'), dst_addr, proto), (strftime(ts, '%Y-%m-%d'), dst_addr))
"""

_P2_PAIRS = """
select strftime(ts, '%Y-%m-%d') as day, dst_addr, src_addr, bit_or(case proto when 6 then 1 else 2 end)::bigint mask
from packets where dst_addr is not null and src_addr is not null and ts is not null and proto in (6, 17) group by all
"""

# Problem 3

_P3_KEYS = ["metric", "day", "service"]


def _values(spark: SparkSession, d: str, once: bool = True) -> DataFrame:
    """metric, day (DATE), service, value of every connection, each once; or of all rows, with rid to tell values apart."""
    c = table(spark, d, "connections").select("conn_id", F.to_date("start_ts").alias("day"), F.coalesce("service", F.lit("unknown")).alias("service"), "byte_count", "pkt_count", "interarrivals_ctos")
    one = lambda m, v, no: F.struct(F.lit(m).alias("metric"), v.alias("value"), no.alias("no"))
    gaps = F.transform(F.coalesce("interarrivals_ctos", F.array().cast("array<bigint>")), lambda g, i: one("interarrivals_ctos_p50", g, i))
    two = F.array(one("byte_count_p90", F.col("byte_count"), F.lit(0)), one("pkt_count_p50", F.col("pkt_count"), F.lit(0)))
    x = (c.distinct() if once else c).select("conn_id", "day", "service", F.explode(F.concat(two, gaps)).alias("x"))
    rid = [] if once else [F.struct("conn_id", "x.no").alias("rid")]
    return x.select("x.metric", "day", "service", "x.value", *rid).where(F.col("value").isNotNull() & F.col("day").isNotNull())


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """The percentile of each metric by day and service, and the number of values."""
    shares = {m: (num, den) for m, (num, den, _) in LIMITS.items()}
    return percentiles.percentiles(_values(spark, d), _P3_KEYS, shares, by="metric", again=_values(spark, d, once=False)).select("metric", F.col("day").cast("string").alias("day"), "service", "value", "total")


def p3_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The same from the histograms of days alone, merged over days: bounds for each metric and service."""
    shares = {m: (num, den) for m, (num, den, _) in LIMITS.items()}
    days = percentiles.histogram(_values(spark, d), _P3_KEYS)
    whole = percentiles.merge_histograms([days.drop("day")], ["metric", "service"])
    return percentiles.percentile_bounds(whole, ["metric", "service"], shares, by="metric").drop("q")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    limit = F.lit(None).cast("bigint")
    for m, (_, _, least) in LIMITS.items():
        limit = F.when(F.col("metric") == m, F.lit(least)).otherwise(limit)
    return p3_percentiles(spark, d).where(F.col("value") >= limit).select(*_P3_KEYS)


_P3_VALUES = """
with c as (select distinct conn_id, strftime(start_ts, '%Y-%m-%d') as day, coalesce(service, 'unknown') service, byte_count, pkt_count, interarrivals_ctos from connections where start_ts is not null),
v as (select 'byte_count_p90' metric, day, service, byte_count as value, 90 q from c union all select 'pkt_count_p50', day, service, pkt_count, 50 from c
  union all select 'interarrivals_ctos_p50', day, service, unnest(interarrivals_ctos), 50 from c)
"""
_P3 = _P3_VALUES + """
, r as (select metric, day, service, value, q, row_number() over (partition by metric, day, service order by value) n, count(*) over (partition by metric, day, service) total from v where value is not null)
select metric, day, service, value, total::bigint total from r where n = greatest(1, (total * q + 99) // 100)
"""

#: The first digit of the histograms, and the least and greatest value of the cell in which the rank lies.
_P3_BOUNDS = _P3_VALUES + """
, w as (select metric, service, value, q, length(bin(abs(value))) - 9 up from v where value is not null),
d as (select *, case when abs(value) < 256 then abs(value) else up * 256 + (abs(value) >> greatest(up, 0)) end size from w),
g as (select *, case when value < 0 then -size - 1 else size end digit from d),
r as (select *, row_number() over (partition by metric, service order by value) n, count(*) over (partition by metric, service) total, min(value) over (partition by metric, service, digit) low, max(value) over (partition by metric, service, digit) high from g)
select metric, service, low, high, total::bigint total from r where n = greatest(1, (total * q + 99) // 100)
"""

# Problem 6


def _records(spark: SparkSession, d: str) -> DataFrame:
    """field, terms of every record, each once."""
    hs = table(spark, d, "ssh_handshakes").select(
        "session_id", F.col("key_exchange.kex_algs").alias("k"), F.col("key_exchange.encryption_algs_client_to_server").alias("e"),
        F.col("client_version_exchange.softwareversion").alias("c"), F.col("server_version_exchange.softwareversion").alias("s"),
    ).distinct()
    fields = {"kex_algs": F.col("k"), "encryption_algs_client_to_server": F.col("e"), "softwareversion": F.array("c", "s")}
    ssh = hs.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), t.alias("terms")) for f, t in fields.items()])).alias("x")).select("x.*")
    dns = table(spark, d, "dns_transactions").select("session_id", F.col("response.response_code").alias("r")).distinct()
    return ssh.unionByName(dns.select(F.lit("response_code").alias("field"), F.array("r").alias("terms")))


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences and records, and its mark."""
    return terms.mark_terms(terms.term_counts(_records(spark, d)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_terms(spark, d).where(F.col("mark").isNotNull()).select("field", "term", "mark")


_P6 = """
with h as (select distinct session_id, key_exchange.kex_algs k, key_exchange.encryption_algs_client_to_server e, client_version_exchange.softwareversion c, server_version_exchange.softwareversion s from ssh_handshakes),
n as (select distinct session_id, response.response_code r from dns_transactions),
rec as (select 'kex_algs' field, session_id, k terms from h union all select 'encryption_algs_client_to_server', session_id, e from h
  union all select 'softwareversion', session_id, [c, s] from h union all select 'response_code', session_id, [r] from n),
o as (select field, session_id, trim(t, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)) term from (select field, session_id, unnest(terms) t from rec)),
ok as (select * from o where term <> ''),
w as (select field, count(distinct session_id) n_with_terms from ok group by field),
t as (select field, term, count(*)::bigint n_occurrences, count(distinct session_id)::bigint n_records from ok group by field, term),
m as (select t.*, n_with_terms::bigint n_with_terms from t join w using (field))
select *, 'rare' mark from m where n_records <= 2 union all select *, 'common' from m where n_records * 2 > n_with_terms
union all select *, null from m where n_records > 2 and n_records * 2 <= n_with_terms
"""

# Problem 7


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of a document and an item found in it, wholly within the error budget or by a run of words."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).where("own").select("doc_id", "item_id").distinct()


# The rule of problem 7 said in SQL, apart from the operator's own code: words after undoing escapes, entities, tags, links,
# gutters, invisible characters and full-width forms, and windows of 13 of them that one item alone holds.
_WIDE, _NARROW = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
_UNSEEN = r"[\x{00ad}\x{061c}\x{180e}\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}-\x{2064}\x{2066}-\x{206f}\x{feff}\x{fe00}-\x{fe0f}\x{034f}]"
_BLOCK_TAGS = "p|br|hr|li|ul|ol|dl|dt|dd|div|td|th|tr|table|tbody|thead|section|article|pre|blockquote|h[1-6]|para"
_P7 = rf"""
with src as (select null::bigint d, item_id i, text from eval_items union all select doc_id, null, text from documents),
a as (select d, i, regexp_replace(text, '\\\r?\n', '', 'g') t from src),
u as (select d, i, case when contains(t, '\u') or contains(t, '\x') or contains(t, '\U') then list_aggregate(list_transform(
    regexp_extract_all(t, '(?s)\\+(?:u\{{[0-9A-Fa-f]{{1,6}}\}}|u[0-9A-Fa-f]{{4}}|U[0-9A-Fa-f]{{8}}|x[0-9A-Fa-f]{{2}})|\\|[^\\]+'),
    lambda p: case when regexp_matches(p, '^\\+[uUx][{{0-9A-Fa-f]') then chr(('0x' || regexp_extract(p, '([0-9A-Fa-f]+)\}}?$', 1))::int) else p end), 'string_agg', '') else t end t from a),
e as (select d, i, regexp_replace(t, '\\+[nrtfvb0]', ' ', 'g') t from u),
h as (select d, i, replace(replace(replace(replace(replace(replace(t, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' ') t from e),
b as (select d, i, regexp_replace(regexp_replace(t, '(?i)</?(?:{_BLOCK_TAGS})\b[^<>]*>', ' ', 'g'), '</?[A-Za-z][^<>]*>|<!--|-->', '', 'g') t from h),
g as (select d, i, regexp_replace(regexp_replace(t, '\]\([^()\s]*\)', ']', 'g'), '(?m)^[^\w\n]*\d+\s*[|\x{{2502}}]', ' ', 'g') t from b),
n as (select d, i, regexp_extract_all(lower(translate(regexp_replace(t, '{_UNSEEN}', '', 'g'), '{_WIDE.replace("'", "''")}', '{_NARROW.replace("'", "''")}')), '[\p{{L}}\p{{N}}]+') w from g),
win as (select d, i, unnest(list_transform(range(1, len(w) - 11), lambda k: array_to_string(w[k:k+12], ' '))) x from n),
own as (select x, min(i) i from win where i is not null group by x having count(distinct i) = 1)
select distinct win.d doc_id, own.i item_id from win join own using (x) where win.i is null
"""

# Problem 8


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", F.col("file_type").alias("topic"), "text")
    listed = table(spark, d, "mix_targets").select(mixing.source_key(F.col("source")).alias("__k")).distinct()
    return mixing.with_tokens(docs.join(listed, mixing.source_key(F.col("source")) == F.col("__k"), "left_semi"))


def p8_met(spark: SparkSession, d: str) -> DataFrame:
    """Every target with whether the raked and capped weights come to it."""
    mix = mixing.plan_mixture(_sized(spark, d), table(spark, d, "mix_targets"))
    return spark.createDataFrame([(r["source"], r["target_share"], r["met"]) for r in mix.sources], "source string, target_share double, met boolean")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_met(spark, d).where("not met").select("source")


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Documents taken for the mixture, with the number of copies."""
    sized = stage(_sized(spark, d), "p8_sized")
    return mixing.take(sized, mixing.plan_mixture(sized, table(spark, d, "mix_targets")).weights)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target, planned and actual share of each listed source, and of each language and topic among what is listed."""
    sized = stage(_sized(spark, d), "p8_sized")
    mix = mixing.plan_mixture(sized, table(spark, d, "mix_targets"))
    met = {r["source"]: r["met"] for r in mix.sources}
    taken = stage(mixing.take(sized, mix.weights).groupBy(mixing.source_key(F.col("source")).alias("k"), "lang", "topic").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("taken"), F.max("copies").alias("most_copies")), "p8_taken")
    parts = [taken.groupBy(F.lit(m).alias("marginal"), F.col(c).alias("v")).agg(F.sum("taken").alias("taken"), F.max("most_copies").alias("most_copies")) for m, c in (("source", "k"), ("lang", "lang"), ("topic", "topic"))]
    got = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumnRenamed("marginal", "m")
    # one row for each target, language and topic
    asked = spark.createDataFrame([("source", k, float(r["size"]), float(r["target"]), float(r["planned"])) for k, r in {(r["source"] or "").strip().lower(): r for r in mix.sources}.items()], "marginal string, value string, size double, target double, planned double")
    rows = asked.unionByName(mix.marginals.where("marginal <> 'source'"))
    out = rows.join(got, (F.col("marginal") == F.col("m")) & F.col("value").eqNullSafe(F.col("v")), "left")
    share = lambda c: F.coalesce(F.col(c) / F.sum(c).over(W.partitionBy("marginal")), F.lit(0.0))  # noqa: E731 a row a value
    unmet = [k.strip().lower() for k, ok in met.items() if k and not ok]
    return out.select("marginal", "value", F.col("size").cast("bigint").alias("size"), share("target").alias("target_share"), share("planned").alias("planned_share"), share("taken").alias("actual_share"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), (~((F.col("marginal") == "source") & F.col("value").isin(unmet))).alias("met"))


#: Sizes are UTF-8 bytes here; the margins are wide enough for these and tokens to give the same rows.
_P8 = """
with s as (select lower(trim(source)) k, sum(strlen(text)) n from documents where source is not null group by 1),
t as (select source, lower(trim(source)) k, target_share, max_repeats from mix_targets),
a as (select sum(n) total from s where k in (select k from t))
select t.source, target_share, coalesce(max_repeats * coalesce(n, 0) >= target_share * total, true) met from t left join s using (k), a
"""

# Problem 9


def p9_sentences(spark: SparkSession, d: str) -> DataFrame:
    """Sentences of every document, whatever its kind."""
    return sentences.split_sentences(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    prose = table(spark, d, "documents").where(F.col("file_type") == "prose")
    return sentences.split_sentences(prose).select("doc_id", "start_char")


QUERIES = {
    "p1_found": p1_found, "p1_frequent": p1_frequent, "p1_counts": p1_counts, "p2_found": p2_found, "p2_sources": p2_sources, "p2_pairs": p2_pairs,
    "p3_found": p3_found, "p3_percentiles": p3_percentiles, "p3_bounds": p3_bounds, "p6_found": p6_found, "p6_terms": p6_terms,
    "p7_found": p7_found, "p7_leaks": p7_leaks, "p8_found": p8_found, "p8_met": p8_met, "p8_mixture": p8_mixture, "p8_shares": p8_shares,
    "p9_found": p9_found, "p9_sentences": p9_sentences,
}
SQL = {
    "p1_found": _P1,
    "p1_counts": _P1_COUNTS,
    "p3_bounds": _P3_BOUNDS,
    "p2_found": f"select day, dst_addr, proto from ({_P2}) where n_distinct >= 30",
    "p2_sources": _P2,
    "p2_pairs": _P2_PAIRS,
    "p3_found": f"select metric, day, service from ({_P3}) where value >= case metric when 'byte_count_p90' then 1000000 when 'pkt_count_p50' then 20 else 50000000 end",
    "p3_percentiles": _P3,
    "p6_found": f"select field, term, mark from ({_P6}) where mark is not null",
    "p6_terms": _P6,
    "p7_found": _P7,
    "p8_found": f"select source from ({_P8}) where not met",
    "p8_met": _P8,
}
