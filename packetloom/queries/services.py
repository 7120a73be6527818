"""Queries on sessions and connections of the tables: delivery by subscription, joins, example analyses, text and bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.filterlang import Filter
from packetloom.functions.net import five_tuple_text, ipv4_subnet, transport_text
from packetloom.operators.pairing import pair_by_transaction, pair_in_order
from packetloom.operators.rules import Rule, match_filters, match_values
from packetloom.plans.subscribe import Subscription, deliver, deliver_all, read_subscriptions
from packetloom.sources.tables import table
from packetloom.sources.traffic import connection_rows, dns_sessions, ssh_sessions, traffic_from_tables

_DEVICE = "case when a like '::ffff:%.%' then substr(a, 8) else a end"


def _end(p: str) -> str:
    a = f"lower(case when {p} like '[%' then regexp_extract({p}, '^\\[([^\\]]*)\\]', 1) else regexp_replace({p}, ':[^:]*$', '') end)"
    return f"case when {a} like '::ffff:%.%' then substr({a}, 8) else {a} end"


_N4 = "(split_part({x}, '.', 1)::bigint * 16777216 + split_part({x}, '.', 2)::bigint * 65536 + split_part({x}, '.', 3)::bigint * 256 + split_part({x}, '.', 4)::bigint)"
_C = f"""
with c0 as (select distinct * from connections),
c1 as (select *, {_end('five_tuple.orig')} orig, {_end('five_tuple.resp')} resp, regexp_extract(five_tuple.orig, ':(\\d+)$', 1)::int orig_port, regexp_extract(five_tuple.resp, ':(\\d+)$', 1)::int resp_port, five_tuple.proto proto from c0),
c as (select *, case when orig like '%:%' then 6 else 4 end ip_version, case when orig not like '%:%' then {_N4.format(x='orig')} end orig_addr, case when resp not like '%:%' then {_N4.format(x='resp')} end resp_addr from c1),
dn as (select distinct * from dns_transactions), sh as (select distinct * from ssh_handshakes),
dq as (select *, coalesce(query.queries[1], '') domain from dn)
"""


def _conn(text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return connection_rows(spark, d).where(Filter(text).on_connections()).select("conn_id", "orig", "resp", F.coalesce("pkt_count", F.lit(-1)).alias("pkt_count"))

    return run


def _ssh(text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        sub = Subscription(text, ("SshHandshake", "FiveTuple"))
        return deliver(sub, traffic_from_tables(spark, d)).select("conn_id", "session_id", F.col("SshHandshake.client_version_exchange.softwareversion").alias("software"))

    return run


def _dns(text: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        sub = Subscription(text, ("DnsTransaction", "FilterStr"))
        return deliver(sub, traffic_from_tables(spark, d)).select("conn_id", "session_id", "FilterStr")

    return run


CONNECTIONS = {
    "stg_protocol": ("tls or ssh", "service in ('tls', 'ssh') and proto = 6"),
    "stg_conn_deliver": ("ipv4.src_addr in 10.0.0.0/8 and http", "orig_addr between 167772160 and 184549375 and ip_version = 4 and service = 'http' and proto = 6"),
    "stg_static": ("tcp.dst_port in 1..1023", "proto = 6 and resp_port between 1 and 1023"),
    "flt_conn_ports": ("udp.port != 53 and dns", "proto = 17 and orig_port <> 53 and resp_port <> 53 and service = 'dns'"),
}
#: name: filter, condition on sh.
_SW = "coalesce(client_version_exchange.softwareversion, '')"
SSH = {
    "op_re": ("ssh.software_version_ctos ~ '^Ferrossh_[0-9]+'", f"regexp_matches({_SW}, '^Ferrossh_[0-9]+')"),
    "op_text_ne": ("ssh.software_version_ctos != 'Ferrossh_3.2'", f"{_SW} <> 'Ferrossh_3.2'"),
    "op_contains": ("ssh.software_version_stoc contains 'sshd'", "contains(coalesce(server_version_exchange.softwareversion, ''), 'sshd')"),
    "op_not_contains": ("ssh.comments_ctos not contains 'Kestrel'", "not contains(coalesce(client_version_exchange.comments, ''), 'Kestrel')"),
    "op_byte_eq": ("ssh.protocol_version_ctos = |32 2E 30|", "coalesce(client_version_exchange.protoversion, '') = '2.0'"),
    "op_byte_contains": ("ssh.key_exchange_cookie_stoc contains |15|", "len(list_filter(range(0, octet_length(coalesce(key_exchange.cookie, ''::blob))), lambda i: substr(hex(key_exchange.cookie), 2 * i + 1, 2) = '15')) > 0"),
    "op_byte_not_contains": ("ssh.key_exchange_cookie_stoc !contains |1A|", "len(list_filter(range(0, octet_length(coalesce(key_exchange.cookie, ''::blob))), lambda i: substr(hex(key_exchange.cookie), 2 * i + 1, 2) = '1A')) = 0"),
    "op_bre": ("ssh.key_exchange_cookie_stoc ~b '^[\\xf0-\\xff]'", "coalesce(hex(key_exchange.cookie), '') like 'F%'"),
    "op_en": ("ssh.comments_ctos eq 'kestrel-4'", "coalesce(client_version_exchange.comments, '') = 'Kestrel-4'"),
    "ex_ssh_bytes": ("ssh.key_exchange_cookie_stoc contains |15| and ssh.software_version_ctos matches '^Ferrossh' and tcp.dst_port = 22", None),
}
DNS = {
    "stg_session": ("dns.query_domain ~ '\\.example$' and udp", "regexp_matches(domain, '\\.example$') and proto = 17"),
    "op_text_eq": ("dns.query_domain = 'time.lumoss.example'", "domain = 'time.lumoss.example'"),
}


def ex_basic(spark: SparkSession, d: str) -> DataFrame:
    """Domain of each DNS session with the record of its connection."""
    sub = Subscription("dns", ("DnsTransaction", "FiveTuple"))
    rows = deliver(sub, traffic_from_tables(spark, d))
    more = connection_rows(spark, d).select("conn_id", "pkt_count", "byte_count", "history")
    return rows.join(more, "conn_id").select("session_id", "conn_id", F.coalesce(F.get("DnsTransaction.query.queries", F.lit(0)), F.lit("")).alias("domain"), F.coalesce("pkt_count", F.lit(-1)).alias("pkt_count"), F.coalesce("byte_count", F.lit(-1)).alias("byte_count"), "history")


TLDS = ("example", "test", "invalid")


#: A specification as users keep it in a file.
SPEC = "\n".join(f"[[subscriptions]]\nfilter = \"dns.query_domain ~ '^.*\\\\.{t}$'\"\ndatatypes = [\"DnsTransaction\", \"FilterStr\"]\ncallback = \"names\"\n" for t in TLDS)


def ex_basic_file(spark: SparkSession, d: str) -> DataFrame:
    """Subscriptions of a TOML specification with the same callback, each row with the filter that let it through."""
    subs = read_subscriptions(SPEC)
    return deliver_all(subs, traffic_from_tables(spark, d))["names"].groupBy("FilterStr").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("conn_id").alias("n_conns"))


def stg_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Nested filters with the same callback deliver a session once."""
    subs = [Subscription(f, ("DnsTransaction",), "names") for f in ("dns", "dns.query_domain contains 'time'", "dns and udp")]
    return deliver_all(subs, traffic_from_tables(spark, d))["names"].select("session_id", "conn_id")


def ex_protocols(spark: SparkSession, d: str) -> DataFrame:
    """Services on ports that are not their own, with the subnet of the responder."""
    odd = {"dns": "dns and ((tcp and tcp.port != 53) or (udp and udp.port != 53))", "http": "http and tcp and tcp.port != 80 and tcp.port != 8080", "tls": "tls and tcp and tcp.port != 443", "quic": "quic and udp.port != 443"}
    c = connection_rows(spark, d).where(F.col("ip_version") == 4)
    kind = F.lit(None).cast("string")
    for name, text in odd.items():
        kind = F.when(Filter(text).on_connections(), F.lit(name)).otherwise(kind)
    return c.withColumn("kind", kind).where(F.col("kind").isNotNull()).select("conn_id", "kind", ipv4_subnet(F.col("resp_addr")).alias("server_subnet"), transport_text(F.col("orig_port"), F.col("resp_port"), F.col("proto")).alias("transport"))


def fn_fivetuple_str(spark: SparkSession, d: str) -> DataFrame:
    tup = F.col("five_tuple")
    c = table(spark, d, "connections").select("conn_id", "five_tuple").distinct()
    return c.select("conn_id", five_tuple_text(tup["orig"], tup["resp"], tup["proto"]).alias("text"))


def jn_dns_txid(spark: SparkSession, d: str) -> DataFrame:
    """Queries and responses told apart and put together again by connection and transaction id; the unmatched remain."""
    t = table(spark, d, "dns_transactions").distinct().where(F.col("conn_id").isNotNull())
    q = t.where(F.col("query").isNotNull()).select("conn_id", "transaction_id", "session_id")
    r = t.where(F.col("response").isNotNull()).select("conn_id", "transaction_id", "session_id", F.col("response.response_code").alias("code"))
    met = pair_by_transaction(q, r, ["conn_id"], "transaction_id", ["session_id"])
    return met.select("conn_id", "transaction_id", "nth", F.coalesce("query.session_id", F.lit(-1)).alias("query_id"), F.coalesce("response.session_id", F.lit(-1)).alias("response_id"), F.col("response.code").alias("code"))


def jn_http_pairing(spark: SparkSession, d: str) -> DataFrame:
    """The k-th query of a connection with its k-th response, as requests in one pipeline are answered in order."""
    t = table(spark, d, "dns_transactions").distinct().where(F.col("conn_id").isNotNull())
    q = t.where(F.col("query").isNotNull()).select("conn_id", "session_id")
    r = t.where(F.col("response").isNotNull()).select("conn_id", "session_id")
    met = pair_in_order(q, r, ["conn_id"], ["session_id"])
    return met.select("conn_id", "depth", F.coalesce("request.session_id", F.lit(-1)).alias("request_id"), F.coalesce("response.session_id", F.lit(-1)).alias("response_id"))


def jn_semi_packets(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of matching connections, and the rest."""
    hit = connection_rows(spark, d).where(Filter("ipv4.dst_addr in 198.18.0.0/15").on_connections()).select("conn_id")
    s = dns_sessions(spark, d).select("session_id", "conn_id")
    yes = s.join(hit, "conn_id", "left_semi").select("session_id", F.lit(True).alias("matched"))
    return yes.unionByName(s.join(hit, "conn_id", "left_anti").select("session_id", F.lit(False).alias("matched")))


def jn_rules_eq(spark: SparkSession, d: str) -> DataFrame:
    """A rule for each supplier's and customer's nation name made into a host name: equality rules by hash join."""
    names = table(spark, d, "nation").select(F.concat(F.lit("rule_"), "n_nationkey").alias("rule"), F.concat(F.lit("mail."), F.lower("n_name"), F.lit(".example")).alias("value"))
    fixed = spark.createDataFrame([("time_sync", "time.lumoss.example"), ("api", "api.lumgri.test")], "rule string, value string")
    s = dns_sessions(spark, d).select("session_id", F.coalesce(F.get("dns.query.queries", F.lit(0)), F.lit("")).alias("domain"))
    return match_values(s, names.unionByName(fixed), F.lower("domain")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


PATTERNS = [("beacon", "^[0-9a-f]{8,}\\."), ("numbered", "[0-9]+\\.[a-z]+\\."), ("time", "^time\\.")]


def jn_rules_re(spark: SparkSession, d: str) -> DataFrame:
    """Pattern rules, all decided in one pass over the sessions."""
    s = dns_sessions(spark, d).select("session_id", F.coalesce(F.get("dns.query.queries", F.lit(0)), F.lit("")).alias("domain"))
    marks = F.array(*[F.when(F.col("domain").rlike(p), F.lit(n)) for n, p in PATTERNS])
    return s.select("session_id", F.explode(F.filter(marks, lambda m: m.isNotNull())).alias("rule"))


#: Families of names, of which a rule each asks for 100 by number; and versions by number, and patterns.
FAMILIES = [f"{a}#.{b}" for a, b in (x.split() for x in "del tavkel.test|tav quoyar.example|lum wilgri.invalid|vex jungri.corp.example|kel grihol.example|vex kelsol.invalid|del zedcor.lab.test|vex yarwil.corp.example|del ossrin.corp.example|quo zedjun.example|gri barin.corp.example|lum wilwil.lab.test|ba morjun.invalid|rin cortav.lab.test|kel rinjun.test".split("|"))]
N_VERSIONS, LETTERS = 59, "abcdfgklmnqrtuvw"


def filter_rules(most: int = 1575) -> list[Rule]:
    """1,500 names, 59 versions and 16 patterns, or an even choice of them."""
    every = [Rule(f"name_{k}_{i}", f"dns.query_domain = '{f.replace('#', str(i))}'") for k, f in enumerate(FAMILIES) for i in range(100)]
    every += [Rule(f"version_{i}", f"ssh.software_version_ctos = 'Ferrossh_{i // 10}.{i % 10}' and tcp.dst_port = 22") for i in range(N_VERSIONS)]
    every += [Rule(f"like_{x}", f"dns.query_domain ~ '^{x}[a-z]+[0-9]+\\.' and udp") for x in LETTERS]
    return every[:: max(1, len(every) // most)][:most]


def session_rows(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of all kinds with what their connections are matched by."""
    t = traffic_from_tables(spark, d)
    ends = [c for c in t.connections.columns if c not in (*t.sessions.columns, "interarrivals_ctos", "interarrivals_stoc")]
    return t.sessions.join(t.connections.select("conn_id", *ends), "conn_id")


def ex_filter_stats(spark: SparkSession, d: str) -> DataFrame:
    """How many sessions each of 1,575 rules lets through."""
    return match_filters(session_rows(spark, d), filter_rules(), stage="session").groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    **{n: _conn(f) for n, (f, _) in CONNECTIONS.items()}, **{n: _ssh(f) for n, (f, _) in SSH.items()}, **{n: _dns(f) for n, (f, _) in DNS.items()},
    **{f.__name__: f for f in (ex_basic, ex_basic_file, stg_dedup, ex_protocols, fn_fivetuple_str, jn_dns_txid, jn_http_pairing, jn_semi_packets, jn_rules_eq, jn_rules_re, ex_filter_stats)},
}
_odd = "case when service = 'quic' and proto = 17 and orig_port <> 443 and resp_port <> 443 then 'quic' when service = 'tls' and proto = 6 and orig_port <> 443 and resp_port <> 443 then 'tls' when service = 'http' and proto = 6 and orig_port not in (80, 8080) and resp_port not in (80, 8080) then 'http' when service = 'dns' and proto in (6, 17) and orig_port <> 53 and resp_port <> 53 then 'dns' end"
_ssh_all = "sh join c using (conn_id) where c.proto = 6"
_ssh_bytes = f"{SSH['op_byte_contains'][1]} and regexp_matches({_SW}, '^Ferrossh') and resp_port = 22"
SQL = {
    **{n: f"{_C} select conn_id, orig, resp, coalesce(pkt_count, -1) pkt_count from c where {w}" for n, (_, w) in CONNECTIONS.items()},
    **{n: f"{_C} select conn_id, session_id, client_version_exchange.softwareversion software from {_ssh_all} and ({w or _ssh_bytes})" for n, (_, w) in SSH.items()},
    **{n: f"{_C} select conn_id, session_id, $f${f}$f$ as \"FilterStr\" from dq join c using (conn_id) where {w}" for n, (f, w) in DNS.items()},
    "ex_basic": f"{_C} select session_id, conn_id, domain, coalesce(pkt_count, -1) pkt_count, coalesce(byte_count, -1) byte_count, history from dq join c using (conn_id)",
    "ex_basic_file": f"{_C} select f as \"FilterStr\", count(*)::bigint n, count(distinct conn_id)::bigint n_conns from (" + " union all ".join(f"select conn_id, $f$dns.query_domain ~ '^.*\\.{t}$'$f$ f from dq join c using (conn_id) where regexp_matches(domain, '^.*\\.{t}$')" for t in TLDS) + ") group by f",
    "stg_dedup": f"{_C} select session_id, conn_id from dq join c using (conn_id)",
    "ex_protocols": f"{_C} select conn_id, {_odd} kind, concat_ws('.', resp_addr >> 24, (resp_addr >> 16) & 255, (resp_addr >> 8) & 255, 0) server_subnet, printf('{{\"proto\": \"%s\", \"src\": \"%d\", \"dst\": \"%d\"}}', case proto when 6 then 'tcp' else 'udp' end, orig_port, resp_port) transport from c where ip_version = 4 and {_odd} is not null",
    "fn_fivetuple_str": "select distinct conn_id, five_tuple.orig || ' -> ' || five_tuple.resp || ' protocol ' || five_tuple.proto as text from connections",
    "jn_dns_txid": f"""{_C}, q as (select conn_id, transaction_id, session_id, row_number() over (partition by conn_id, transaction_id order by session_id) nth from dn where conn_id is not null and query is not null),
r as (select conn_id, transaction_id, session_id, response.response_code code, row_number() over (partition by conn_id, transaction_id order by session_id) nth from dn where conn_id is not null and response is not null)
select conn_id, transaction_id, nth::int nth, coalesce(q.session_id, -1) query_id, coalesce(r.session_id, -1) response_id, r.code from q full join r using (conn_id, transaction_id, nth)""",
    "jn_http_pairing": f"""{_C}, q as (select conn_id, session_id, row_number() over (partition by conn_id order by session_id) depth from dn where conn_id is not null and query is not null),
r as (select conn_id, session_id, row_number() over (partition by conn_id order by session_id) depth from dn where conn_id is not null and response is not null)
select conn_id, depth::int depth, coalesce(q.session_id, -1) request_id, coalesce(r.session_id, -1) response_id from q full join r using (conn_id, depth)""",
    "jn_semi_packets": f"{_C}, hit as (select conn_id from c where ip_version = 4 and resp_addr between 3323068416 and 3323199487) select session_id, coalesce(conn_id in (select conn_id from hit), false) matched from dn",
    "jn_rules_eq": f"{_C}, rules as (select 'rule_' || n_nationkey as rule, 'mail.' || lower(n_name) || '.example' as value from nation union all values ('time_sync', 'time.lumoss.example'), ('api', 'api.lumgri.test')) select rule, count(*)::bigint n from dq join rules on lower(domain) = value group by rule",
    "jn_rules_re": f"{_C} " + " union all ".join(f"select session_id, '{n}' as rule from dq where regexp_matches(domain, '{p}')" for n, p in PATTERNS),
    "ex_filter_stats": f"""{_C}, names as (select 'name_' || k || '_' || i as rule, replace(f, '#', i::varchar) as name from (select unnest({FAMILIES}) f, unnest(range(0, {len(FAMILIES)})) k), (select unnest(range(0, 100)) i)),
q as (select domain, proto from dq join c using (conn_id)), h as (select {_SW} sw, resp_port from {_ssh_all})
select rule, count(*)::bigint n from (select rule from q join names on domain = name union all select 'version_' || i from h join (select unnest(range(0, {N_VERSIONS})) i) on sw = 'Ferrossh_' || i // 10 || '.' || i % 10 where resp_port = 22
  union all select 'like_' || x from q join (select unnest({list(LETTERS)}) x) on proto = 17 and regexp_matches(domain, '^' || x || '[a-z]+[0-9]+\\.')) group by rule""",
}
