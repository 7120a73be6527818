"""Filters on Python values, for operators that decide while they hold a connection's state.

The same outcome as the columns of compile.py: a missing value of a session is '' or 0, one of a header holds nothing.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import lru_cache

import regex

from packetloom.filterlang.ast import HEADERS, IntRange, Net, Op, Predicate
from packetloom.filterlang.fields import BYTES, SESSION_FIELDS
from packetloom.filterlang.parse import And, Or, Tree

#: Where a session field lies in the session's dict, for those that are a plain path. Fixed values.
PATHS: dict[str, dict[str, str]] = {
    "tls": {"sni": "client_hello.server_name", "client_version": "client_hello.version", "server_version": "server_hello.version", "cipher": "server_hello.cipher_suite", "compression_alg": "server_hello.compression_alg", "client_random": "client_hello.random", "server_random": "server_hello.random"},
    "http": {f: f"{side}.{name}" for side in ("request", "response") for f, name in {
        "request": {"uri": "uri", "method": "method", "request_version": "version", "user_agent": "user_agent", "cookie": "cookie", "host": "host", "request_content_length": "content_length", "request_content_type": "content_type", "request_transfer_encoding": "transfer_encoding"},
        "response": {"response_version": "version", "status_code": "status_code", "status_msg": "status_msg", "response_content_length": "content_length", "response_content_type": "content_type", "response_transfer_encoding": "transfer_encoding"},
    }[side].items()},
    "ssh": {f"{name}_{way}": f"{side}_version_exchange.{field}" for way, side in (("ctos", "client"), ("stoc", "server")) for name, field in (("protocol_version", "protoversion"), ("software_version", "softwareversion"), ("comments", "comments"))} | {"key_exchange_cookie_stoc": "key_exchange.cookie"},
}


def _at(session: dict, path: str) -> object | None:
    v: object | None = session
    for name in path.split("."):
        if not isinstance(v, dict):
            return None
        v = v.get(name)
    return v


def _written(value: object) -> str:
    """JSON as the engine writes it: without nulls and blanks."""
    bare = lambda v: {k: bare(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else [bare(x) for x in v] if isinstance(v, list) else v
    return json.dumps(bare(value), separators=(",", ":"), ensure_ascii=False)


def _ja3(session: dict, of_server: bool) -> str:
    h = session.get("server_hello" if of_server else "client_hello")
    if h is None:
        return ""
    plain = lambda xs: "-".join(str(x) for x in xs if x & 0x0F0F != 0x0A0A or x >> 8 != x & 255)
    if of_server:
        return ",".join((str(h["version"]), str(h["cipher_suite"]), plain(h["extension_list"])))
    return ",".join((str(h["version"]), plain(h["cipher_suites"]), plain(h["extension_list"]), plain(h["supported_groups"]), "-".join(map(str, h["ec_point_formats"]))))


def session_value(proto: str, field: str, session: dict) -> object:
    """The value of a session field; '' , 0 or no bytes where it is missing."""
    kind = SESSION_FIELDS[proto][field][0]
    empty = b"" if kind == BYTES else 0 if kind == "int" else ""
    if field in PATHS.get(proto, {}):
        v = _at(session, PATHS[proto][field])
    elif proto == "tls" and field == "version":
        v = next((x for x in (_at(session, "server_hello.selected_version"), _at(session, "server_hello.version"), _at(session, "client_hello.version")) if x is not None), None)
    elif proto == "tls":
        text = _ja3(session, field.startswith("ja3s"))
        v = hashlib.md5(text.encode()).hexdigest() if field.endswith("hash") else text
    elif field == "query_domain":
        v = next(iter(_at(session, "query.queries") or []), None)
    elif field == "response":
        v = _written(session["response"]) if session.get("response") is not None else None
    else:
        found = _at(session, f"response.{field}")
        v = _written(found) if found else None
    return empty if v is None else v


@lru_cache(maxsize=4096)
def _pattern(text: str, of_bytes: bool) -> regex.Pattern:
    out, at, inside = [], 0, 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            out.append(text[at : at + 2])
            at += 2
            continue
        inside += (c == "[") - (c == "]" and inside > 0)
        out.append(r"\Z" if c == "$" and not inside else c)
        at += 1
    return regex.compile("".join(out).replace("(?-u)", "").replace("(?-u:", "(?:"), regex.ASCII if of_bytes else 0)


def compare(value: object | None, p: Predicate) -> bool:
    """Whether a value meets the comparison of a predicate; a null one meets none."""
    if value is None:
        return False
    v, op = p.value, p.op
    if isinstance(v, IntRange | Net):
        if isinstance(value, bytes | bytearray):
            value = int.from_bytes(value, "big")
        inside = v.low <= value <= v.high
        return not inside if op is Op.NE else inside
    if isinstance(v, int):
        return {Op.EQ: value == v, Op.NE: value != v, Op.GE: value >= v, Op.LE: value <= v, Op.GT: value > v, Op.LT: value < v}[op]
    if isinstance(v, bytes):
        data = value.encode() if isinstance(value, str) else bytes(value)
        return {Op.EQ: data == v, Op.NE: data != v, Op.CONTAINS: v in data, Op.NOT_CONTAINS: v not in data}[op]
    if op is Op.RE:
        return _pattern(v, False).search(value) is not None
    if op is Op.BYTE_RE:
        return _pattern(v, True).search((value.encode() if isinstance(value, str) else bytes(value)).decode("latin-1")) is not None
    if op is Op.EN:
        return value == "".join(w[:1].upper() + w[1:] for w in v.split("_"))
    return {Op.EQ: value == v, Op.NE: value != v, Op.CONTAINS: v in value, Op.NOT_CONTAINS: v not in value}[op]


def matches(tree: Tree, decide: Callable[[Predicate], bool]) -> bool:
    """A filter's tree by what decides its predicates."""
    if isinstance(tree, Predicate):
        return decide(tree)
    if isinstance(tree, And):
        return all(matches(t, decide) for t in tree.parts)
    if isinstance(tree, Or):
        return any(matches(t, decide) for t in tree.parts)
    return True


def on_connection(ends: dict, service: str | None, session: dict | None = None) -> Callable[[Predicate], bool]:
    """Decides predicates on a connection (ip_version, proto, orig_ip, resp_ip, orig_port, resp_port) whose protocol is
    known, and on one of its sessions."""

    def decide(p: Predicate) -> bool:
        if p.proto not in HEADERS:
            if service != p.proto:
                return False
            return True if p.unary else session is not None and compare(session_value(p.proto, p.field, session), p)
        layer = {"ethernet": True, "ipv4": ends["ip_version"] == 4, "ipv6": ends["ip_version"] == 6, "tcp": ends["proto"] == 6, "udp": ends["proto"] == 17}[p.proto]
        if p.unary or not layer:
            return layer
        side = "orig" if p.field.startswith("src") else "resp"
        return compare(ends[f"{side}_{'port' if p.field.endswith('port') else 'ip'}"], p)

    return decide
