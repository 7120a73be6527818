"""QUIC packets: headers, and the TLS hello inside client Initial packets."""

from __future__ import annotations

import hashlib
import hmac

from packetloom.parsers import tls
from packetloom.parsers.aes import encrypt_block, gcm_plain
from packetloom.parsers.base import Parser, Probe, Reader, Truncated, register

#: Salts of the initial secrets by version. Fixed values.
_SALTS = {
    1: "38762cf7f55934b34d179ae6a4c80cadccbb7f0a",
    0x6B3343CF: "0dede3def700a6db819381be6e269dcbf9bd2ed9",
    **{0xFF000000 | n: "afbfec289993d24c9e9786f19c6111e04390a899" for n in (29, 30, 31, 32)},
    **{0xFF000000 | n: "c3eef712c72ebb5a11a7d2432bb46365bef9f502" for n in (27, 28)},
}
_TYPES = ("Initial", "ZeroRTT", "Handshake", "Retry")
_TYPES_2 = ("Retry", "Initial", "ZeroRTT", "Handshake")


def varint(r: Reader) -> int:
    first = r.uint(1)
    size = 1 << (first >> 6)
    return (first & 0x3F) << 8 * (size - 1) | (r.uint(size - 1) if size > 1 else 0)


def _expand(secret: bytes, label: bytes, size: int) -> bytes:
    full = b"tls13 " + label
    info = size.to_bytes(2, "big") + bytes([len(full)]) + full + b"\0"
    return hmac.new(secret, info + b"\x01", hashlib.sha256).digest()[:size]


def initial_keys(version: int, dcid: bytes, client: bool) -> tuple[bytes, bytes, bytes]:
    """Key, initialisation vector and header key of Initial packets of one side."""
    first = hmac.new(bytes.fromhex(_SALTS[version]), dcid, hashlib.sha256).digest()
    secret = _expand(first, b"client in" if client else b"server in", 32)
    name = b"quicv2 " if version == 0x6B3343CF else b"quic "
    return _expand(secret, name + b"key", 16), _expand(secret, name + b"iv", 12), _expand(secret, name + b"hp", 16)


def open_initial(packet: bytes, number_at: int, end: int, keys: tuple[bytes, bytes, bytes]) -> bytes:
    """The frames of an Initial packet that starts at 0 and whose packet number field starts at number_at."""
    key, iv, header_key = keys
    sample = packet[number_at + 4 : number_at + 20]
    if len(sample) < 16:
        raise Truncated("sample")
    mask = encrypt_block(header_key, sample)
    size = ((packet[0] ^ mask[0] & 0x0F) & 3) + 1
    number = int.from_bytes(bytes(a ^ b for a, b in zip(packet[number_at : number_at + size], mask[1:], strict=False)), "big")
    nonce = (int.from_bytes(iv, "big") ^ number).to_bytes(12, "big")
    return gcm_plain(key, nonce, packet[number_at + size : end])


def read_frames(data: bytes) -> tuple[list[str], list[tuple[int, bytes]]]:
    """Names of the frames, and the pieces of the crypto stream with their offsets."""
    r, names, crypto = Reader(data), [], []
    while r.left:
        kind = varint(r)
        if kind == 0:
            if not names or names[-1] != "Padding":
                names.append("Padding")
        elif kind == 1:
            names.append("Ping")
        elif kind in (2, 3):
            names.append("Ack")
            varint(r), varint(r)
            ranges = varint(r)
            varint(r)
            for _ in range(2 * ranges + (3 if kind == 3 else 0)):
                varint(r)
        elif kind == 6:
            names.append("Crypto")
            offset = varint(r)
            crypto.append((offset, r.take(varint(r))))
        else:
            break  # no other frame belongs into an Initial packet but a close
    return names, crypto


@register
class Quic(Parser):
    protocol = "quic"

    def __init__(self) -> None:
        self.packets: list[dict] = []
        self.cids: set[str] = set()
        self.first_dcid: bytes | None = None
        self.crypto: dict[bool, dict[int, bytes]] = {True: {}, False: {}}
        self.tls = tls.empty()
        self.done = False

    def probe(self, data, to_server, ports, udp):
        if not udp or len(data) < 5 or not data[0] & 0x40:
            return Probe.NOT_FOR_US
        if not data[0] & 0x80:
            return Probe.UNSURE
        return Probe.CERTAIN if int.from_bytes(data[1:5], "big") in _SALTS else Probe.NOT_FOR_US

    def feed(self, data, to_server):
        if self.done:
            return []
        try:
            short = self._datagram(data, to_server)
        except (Truncated, ValueError):
            return []
        if short:
            self.done = True
            return [self._session()]
        return []

    def _datagram(self, data: bytes, to_server: bool) -> bool:
        """Takes all packets of a datagram; whether the last has a short header."""
        while data:
            if not data[0] & 0x80:
                if not data[0] & 0x40:
                    return False  # padding after the packets
                size = max((len(c) // 2 for c in self.cids if data[1:].hex().startswith(c)), default=0)
                self.packets.append({"header_type": "Short", "packet_type": None, "version": None, "dcid": data[1 : 1 + size].hex(), "scid": None, "token": None, "retry_tag": None, "payload_bytes_count": len(data) - 1 - size, "frames": []})
                return True
            r = Reader(data, 1)
            version = r.uint(4)
            dcid, scid = r.block(1), r.block(1)
            if version not in _SALTS:
                raise ValueError("version")
            kind = (_TYPES_2 if version == 0x6B3343CF else _TYPES)[data[0] >> 4 & 3]
            self.cids |= {c.hex() for c in (dcid, scid) if c}
            p = {"header_type": "Long", "packet_type": kind, "version": version, "dcid": dcid.hex(), "scid": scid.hex(), "token": None, "retry_tag": None, "payload_bytes_count": None, "frames": []}
            if kind == "Retry":
                p |= {"token": data[r.at : -16], "retry_tag": data[-16:], "payload_bytes_count": 0}
                self.packets.append(p)
                self.first_dcid = scid  # the client's next Initial is keyed by it
                return False
            if kind == "Initial":
                p["token"] = r.take(varint(r))
                if to_server and self.first_dcid is None:
                    self.first_dcid = dcid
            length = varint(r)
            at, end = r.at, r.at + length
            if end > len(data):
                raise Truncated("packet")
            p["payload_bytes_count"] = length
            if kind == "Initial" and self.first_dcid is not None:
                try:
                    p["frames"], pieces = read_frames(open_initial(data, at, end, initial_keys(version, self.first_dcid, to_server)))
                    for offset, piece in pieces:
                        self.crypto[to_server][offset] = piece
                    self._hello(to_server)
                except (Truncated, ValueError):
                    pass
            self.packets.append(p)
            data = data[end:]
        return False

    def _hello(self, to_server: bool) -> None:
        stream = b""
        for offset, piece in sorted(self.crypto[to_server].items()):
            if offset > len(stream):
                return
            stream += piece[len(stream) - offset :]
        if len(stream) >= 4 and len(stream) >= 4 + (n := int.from_bytes(stream[1:4], "big")):
            tls.note(self.tls, stream[0], stream[4 : 4 + n], to_server)

    def _session(self) -> dict:
        return {"packets": self.packets, "cids": sorted(self.cids), "tls": self.tls}

    def drain(self):
        return [] if self.done or not self.packets else [self._session()]
