"""SSH handshakes: versions, key exchange lists, Diffie-Hellman values, new keys."""

from __future__ import annotations

from packetloom.parsers.base import Parser, Probe, Reader, Truncated, register

_KEXINIT, _NEWKEYS, _DH_INIT, _DH_REPLY = 20, 21, 30, 31
#: Lists of a key exchange in their order. Fixed values.
_LISTS = ("kex_algs", "server_host_key_algs", "encryption_algs_client_to_server", "encryption_algs_server_to_client", "mac_algs_client_to_server", "mac_algs_server_to_client", "compression_algs_client_to_server", "compression_algs_server_to_client", "languages_client_to_server", "languages_server_to_client")


def _version(line: bytes) -> dict:
    text = line.decode("utf-8", "replace").rstrip("\r")
    ident, blank, comments = text.partition(" ")
    parts = ident.split("-", 2)
    return {"protoversion": parts[1] if len(parts) > 1 else None, "softwareversion": parts[2] if len(parts) > 2 else None, "comments": comments if blank else None}


@register
class Ssh(Parser):
    protocol = "ssh"

    def __init__(self) -> None:
        self.buffer = {True: b"", False: b""}
        self.said = {True: False, False: False}
        self.session = {"client_version_exchange": None, "server_version_exchange": None, "key_exchange": None, "client_dh": None, "server_dh": None, "client_new_keys": False, "server_new_keys": False}
        self.done = False

    def probe(self, data, to_server, ports, udp):
        if udp:
            return Probe.NOT_FOR_US
        if len(data) < 4:
            return Probe.UNSURE if b"SSH-".startswith(data) else Probe.NOT_FOR_US
        return Probe.CERTAIN if data.startswith(b"SSH-") else Probe.NOT_FOR_US

    def feed(self, data, to_server):
        if self.done:
            return []
        buffer = self.buffer[to_server] + data
        s = self.session
        if not self.said[to_server]:
            line, end, rest = buffer.partition(b"\n")
            if not end:
                self.buffer[to_server] = buffer
                return []
            if line.startswith(b"SSH-"):
                s["client_version_exchange" if to_server else "server_version_exchange"] = _version(line)
                self.said[to_server] = True
            buffer = rest
        while len(buffer) >= 5 and not s["client_new_keys" if to_server else "server_new_keys"]:
            n = int.from_bytes(buffer[:4], "big")
            if len(buffer) < 4 + n or n < 2:
                break
            self._message(buffer[5 : 4 + n - buffer[4]], to_server)
            buffer = buffer[4 + n :]
        self.buffer[to_server] = buffer
        if s["client_new_keys"] and s["server_new_keys"]:
            self.done = True
            return [s]
        return []

    def _message(self, m: bytes, to_server: bool) -> None:
        s = self.session
        if not m:
            return
        try:
            if m[0] == _KEXINIT and s["key_exchange"] is None:
                r = Reader(m, 1)
                kex: dict = {"cookie": r.take(16)}
                for name in _LISTS:
                    text = r.block(4).decode("utf-8", "replace")
                    kex[name] = text.split(",") if text else []
                s["key_exchange"] = kex | {"first_kex_packet_follows": bool(r.uint(1))}
            elif m[0] == _DH_INIT and to_server:
                s["client_dh"] = Reader(m, 1).block(4)
            elif m[0] == _DH_REPLY and not to_server:
                r = Reader(m, 1)
                s["server_dh"] = {"host_key": r.block(4), "f": r.block(4), "signature": r.block(4)}
            elif m[0] == _NEWKEYS:
                s["client_new_keys" if to_server else "server_new_keys"] = True
        except Truncated:
            pass

    def drain(self):
        return [] if self.done or not any(self.said.values()) else [self.session]
