"""TLS handshakes: hellos with their extensions, certificates and key exchanges as bytes."""

from __future__ import annotations

from packetloom.parsers.base import Parser, Probe, Reader, Truncated, register

_MOST = 1 << 24


def _ints(data: bytes, n: int) -> list[int]:
    return [int.from_bytes(data[i : i + n], "big") for i in range(0, len(data) - n + 1, n)]


def _extensions(r: Reader) -> list[tuple[int, bytes]]:
    out = []
    if r.left >= 2:
        e = Reader(r.block(2))
        while e.left >= 4:
            out.append((e.uint(2), e.block(2)))
    return out


def _names(data: bytes) -> list[str]:
    r, out = Reader(Reader(data).block(2)), []
    while r.left:
        out.append(r.block(1).decode("utf-8", "replace"))
    return out


def client_hello(body: bytes) -> dict:
    r = Reader(body)
    h: dict = {"version": r.uint(2), "random": r.take(32), "session_id": r.block(1), "cipher_suites": _ints(r.block(2), 2), "compression_algs": list(r.block(1))}
    h |= {"extension_list": [], "server_name": None, "supported_groups": [], "ec_point_formats": [], "alpn_protocols": [], "signature_algs": [], "key_shares": [], "supported_versions": []}
    for kind, data in _extensions(r):
        h["extension_list"].append(kind)
        try:
            if kind == 0 and data:
                names = Reader(Reader(data).block(2))
                while names.left:
                    sort, name = names.uint(1), names.block(2)
                    if sort == 0 and h["server_name"] is None:
                        h["server_name"] = name.decode("utf-8", "replace")
            elif kind == 10:
                h["supported_groups"] = _ints(Reader(data).block(2), 2)
            elif kind == 11:
                h["ec_point_formats"] = list(Reader(data).block(1))
            elif kind == 13:
                h["signature_algs"] = _ints(Reader(data).block(2), 2)
            elif kind == 16:
                h["alpn_protocols"] = _names(data)
            elif kind == 43:
                h["supported_versions"] = _ints(Reader(data).block(1), 2)
            elif kind == 51:
                shares = Reader(Reader(data).block(2))
                while shares.left:
                    h["key_shares"].append({"group": shares.uint(2), "kx_data": shares.block(2)})
        except Truncated:
            continue
    return h


def server_hello(body: bytes) -> dict:
    r = Reader(body)
    h: dict = {"version": r.uint(2), "random": r.take(32), "session_id": r.block(1), "cipher_suite": r.uint(2), "compression_alg": r.uint(1), "extension_list": [], "ec_point_formats": [], "alpn_protocol": None, "key_share": None, "selected_version": None}
    for kind, data in _extensions(r):
        h["extension_list"].append(kind)
        try:
            if kind == 11:
                h["ec_point_formats"] = list(Reader(data).block(1))
            elif kind == 16:
                h["alpn_protocol"] = next(iter(_names(data)), None)
            elif kind == 43:
                h["selected_version"] = Reader(data).uint(2)
            elif kind == 51:
                k = Reader(data)
                h["key_share"] = {"group": k.uint(2), "kx_data": k.block(2) if k.left else b""}
        except Truncated:
            continue
    return h


def empty() -> dict:
    return {"client_hello": None, "server_hello": None, "server_certificates": [], "client_certificates": [], "server_key_exchange": None, "client_key_exchange": None}


def note(session: dict, kind: int, body: bytes, to_server: bool) -> None:
    """Puts one handshake message into a session; messages that can't be read leave it as it is."""
    try:
        if kind == 1 and session["client_hello"] is None:
            session["client_hello"] = client_hello(body)
        elif kind == 2:
            session["server_hello"] = server_hello(body)
        elif kind == 11:
            r = Reader(Reader(body).block(3))
            where = session["client_certificates" if to_server else "server_certificates"]
            while r.left:
                where.append(r.block(3))
        elif kind == 12:
            session["server_key_exchange"] = body
        elif kind == 16:
            session["client_key_exchange"] = body
    except Truncated:
        pass


@register
class Tls(Parser):
    protocol = "tls"

    def __init__(self) -> None:
        self.records = {True: b"", False: b""}
        self.messages = {True: b"", False: b""}
        self.sealed = {True: False, False: False}
        self.session = empty()
        self.done = False

    def probe(self, data, to_server, ports, udp):
        if udp:
            return Probe.NOT_FOR_US
        if len(data) <= 2:
            return Probe.UNSURE
        return Probe.CERTAIN if 0x14 <= data[0] <= 0x17 and data[1] == 3 and data[2] <= 3 else Probe.NOT_FOR_US

    def feed(self, data, to_server):
        if self.done:
            return []
        buffer = self.records[to_server] + data
        over = False
        while len(buffer) >= 5 and len(buffer) >= 5 + (n := int.from_bytes(buffer[3:5], "big")):
            kind, body, buffer = buffer[0], buffer[5 : 5 + n], buffer[5 + n :]
            if kind == 0x14:
                self.sealed[to_server] = True
                over = over or to_server
            elif kind == 0x17 or kind == 0x15 and body[:1] == b"\x02":
                over = True  # content, or a fatal alert
            elif kind == 0x16 and not self.sealed[to_server]:
                self._handshake(body, to_server)
        self.records[to_server] = self._kept(buffer)
        if over and (self.session["server_hello"] is not None or self.sealed[True]):
            self.done = True
            return [self.session]
        return []

    def _handshake(self, data: bytes, to_server: bool) -> None:
        m = self.messages[to_server] + data
        while len(m) >= 4 and len(m) >= 4 + (n := int.from_bytes(m[1:4], "big")):
            note(self.session, m[0], m[4 : 4 + n], to_server)
            m = m[4 + n :]
        self.messages[to_server] = self._kept(m)

    def _kept(self, data: bytes) -> bytes:
        if len(data) <= _MOST:
            return data
        self.lost += len(data)
        return b""

    def drain(self):
        return [] if self.done or (self.session["client_hello"] is None and self.session["server_hello"] is None) else [self.session]
