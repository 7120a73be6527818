"""Fields that filters may ask for, and the columns that hold them.

Header fields are columns of a packet table, as header columns of the decoder are named or as the plain packet schema
names them. Session fields are made from the structs tls, http, dns and ssh of a session row; a missing value is '' or 0,
so that every comparison is true or false.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

INT, ADDR, TEXT, BYTES = "int", "addr", "text", "bytes"

#: Header fields by protocol; the types are INT but for addresses. Fixed values.
HEADER_FIELDS: dict[str, tuple[str, ...]] = {
    "ipv4": ("version", "ihl", "version_ihl", "dscp", "ecn", "dscp_ecn", "type_of_service", "total_length", "identification", "flags_to_fragment_offset", "flags", "rf", "df", "mf", "fragment_offset", "time_to_live", "protocol", "header_checksum", "src_addr", "dst_addr"),
    "ipv6": ("version", "dscp", "ecn", "traffic_class", "flow_label", "version_to_flow_label", "payload_length", "next_header", "hop_limit", "src_addr", "dst_addr"),
    "tcp": ("src_port", "dst_port", "seq_no", "ack_no", "data_offset", "reserved", "data_offset_to_ns", "flags", "window", "checksum", "urgent_pointer", "ns", "cwr", "ece", "urg", "ack", "psh", "rst", "syn", "fin", "synack"),
    "udp": ("src_port", "dst_port", "length", "checksum"),
}
#: Bits of the TCP flags.
TCP_BITS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32, "ece": 64, "cwr": 128}


def _text(path: str) -> Callable[[], Column]:
    return lambda: F.coalesce(F.col(path), F.lit(""))


def _number(path: str) -> Callable[[], Column]:
    return lambda: F.coalesce(F.col(path).cast("bigint"), F.lit(0).cast("bigint"))


def _json(path: str) -> Callable[[], Column]:
    return lambda: F.coalesce(F.when(F.size(path) > 0, F.to_json(F.col(path))), F.lit(""))


def _reply() -> Column:
    return F.coalesce(F.when(F.col("dns.response").isNotNull(), F.to_json("dns.response")), F.lit(""))


#: Session fields: protocol, field: type and column.
SESSION_FIELDS: dict[str, dict[str, tuple[str, Callable[[], Column]]]] = {
    "tls": {
        "sni": (TEXT, _text("tls.client_hello.server_name")),
        "client_version": (INT, _number("tls.client_hello.version")),
        "server_version": (INT, _number("tls.server_hello.version")),
        "version": (INT, lambda: F.coalesce(F.col("tls.server_hello.selected_version"), F.col("tls.server_hello.version"), F.col("tls.client_hello.version"), F.lit(0)).cast("bigint")),
        "cipher": (INT, _number("tls.server_hello.cipher_suite")),
        "compression_alg": (INT, _number("tls.server_hello.compression_alg")),
        "client_random": (BYTES, lambda: F.coalesce(F.col("tls.client_hello.random"), F.lit(b""))),
        "server_random": (BYTES, lambda: F.coalesce(F.col("tls.server_hello.random"), F.lit(b""))),
        "ja3_str": (TEXT, lambda: _ja("ja3_string")),
        "ja3_hash": (TEXT, lambda: F.md5(_ja("ja3_string").cast("binary"))),
        "ja3s_str": (TEXT, lambda: _ja("ja3s_string")),
        "ja3s_hash": (TEXT, lambda: F.md5(_ja("ja3s_string").cast("binary"))),
    },
    "http": {
        "uri": (TEXT, _text("http.request.uri")), "method": (TEXT, _text("http.request.method")), "request_version": (TEXT, _text("http.request.version")),
        "user_agent": (TEXT, _text("http.request.user_agent")), "cookie": (TEXT, _text("http.request.cookie")), "host": (TEXT, _text("http.request.host")),
        "request_content_length": (INT, _number("http.request.content_length")), "request_content_type": (TEXT, _text("http.request.content_type")),
        "request_transfer_encoding": (TEXT, _text("http.request.transfer_encoding")), "response_version": (TEXT, _text("http.response.version")),
        "status_code": (INT, _number("http.response.status_code")), "status_msg": (TEXT, _text("http.response.status_msg")),
        "response_content_length": (INT, _number("http.response.content_length")), "response_content_type": (TEXT, _text("http.response.content_type")),
        "response_transfer_encoding": (TEXT, _text("http.response.transfer_encoding")),
    },
    "dns": {
        "query_domain": (TEXT, lambda: F.coalesce(F.get("dns.query.queries", F.lit(0)), F.lit(""))),
        "answers": (TEXT, _json("dns.response.answers")), "nameservers": (TEXT, _json("dns.response.nameservers")),
        "additionals": (TEXT, _json("dns.response.additionals")), "response": (TEXT, _reply),
    },
    "ssh": {
        "protocol_version_ctos": (TEXT, _text("ssh.client_version_exchange.protoversion")), "software_version_ctos": (TEXT, _text("ssh.client_version_exchange.softwareversion")),
        "comments_ctos": (TEXT, _text("ssh.client_version_exchange.comments")), "protocol_version_stoc": (TEXT, _text("ssh.server_version_exchange.protoversion")),
        "software_version_stoc": (TEXT, _text("ssh.server_version_exchange.softwareversion")), "comments_stoc": (TEXT, _text("ssh.server_version_exchange.comments")),
        "key_exchange_cookie_stoc": (BYTES, lambda: F.coalesce(F.col("ssh.key_exchange.cookie"), F.lit(b""))),
    },
    "quic": {},
}


def _ja(which: str) -> Column:
    from packetloom.functions import fingerprints

    return getattr(fingerprints, which)()


def header_column(proto: str, name: str, columns: set[str]) -> Column | None:
    """The column of a header field, from a decoded column or from one of the plain packet schema; None if there is none."""
    for c in (f"{proto}_{name}", name):
        if c in columns:
            return F.col(c)
    if proto == "tcp" and "tcp_flags" in columns:
        flags = F.col("tcp_flags")
        if name == "flags":
            return flags
        if name in TCP_BITS:
            return F.when(flags.bitwiseAND(TCP_BITS[name]) != 0, 1).otherwise(0)
        if name == "synack":  # either of the two bits
            return F.when(flags.bitwiseAND(TCP_BITS["syn"] | TCP_BITS["ack"]) != 0, 1).otherwise(0)
    if name == "version" and "ip_version" in columns:
        return F.col("ip_version")
    if name in ("protocol", "next_header") and "proto" in columns:
        return F.col("proto")
    return None
