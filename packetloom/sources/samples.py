"""Frames made byte by byte: captures for tests and for trying things out."""

from __future__ import annotations

import ipaddress
import struct

FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16


def ethernet(body: bytes, kind: int, vlan: int | None = None) -> bytes:
    tag = struct.pack("!HH", 0x8100, vlan) if vlan is not None else b""
    return bytes.fromhex("0200000000010200000000aa") + tag + struct.pack("!H", kind) + body


def ip(src: str, dst: str, proto: int, body: bytes, ttl: int = 64, length: int | None = None) -> tuple[bytes, int]:
    a, b = ipaddress.ip_address(src), ipaddress.ip_address(dst)
    if a.version == 4:
        return struct.pack("!BBHHHBBH", 0x45, 0, len(body) + 20 if length is None else length, 7, 0x4000, ttl, proto, 0) + a.packed + b.packed + body, 0x0800
    return struct.pack("!IHBB", 6 << 28, len(body) if length is None else length, proto, ttl) + a.packed + b.packed + body, 0x86DD


def udp(src: str, sport: int, dst: str, dport: int, data: bytes, vlan: int | None = None, **kw) -> bytes:
    return ethernet(*ip(src, dst, 17, struct.pack("!HHHH", sport, dport, 8 + len(data), 0) + data, **kw), vlan)


def tcp(src: str, sport: int, dst: str, dport: int, flags: int, seq: int = 0, ack: int = 0, data: bytes = b"", vlan: int | None = None, **kw) -> bytes:
    head = struct.pack("!HHIIBBHHH", sport, dport, seq % (1 << 32), ack % (1 << 32), 5 << 4, flags, 1024, 0, 0)
    return ethernet(*ip(src, dst, 6, head + data, **kw), vlan)


def talk(turns: list[tuple[bool, bytes]], client: tuple[str, int] = ("10.0.0.1", 40000), server: tuple[str, int] = ("198.18.0.9", 80), start: int = 0, isn: int = 1000, step: int = 1000, close: bool = True) -> list[tuple[int, bytes]]:
    """A whole TCP connection of (to server, bytes) as timed frames."""
    seq = {True: isn, False: isn + 500_000}
    out = []

    def say(way: bool, flags: int, data: bytes = b"") -> None:
        a, b = (client, server) if way else (server, client)
        out.append((start + step * len(out), tcp(*a, *b, flags, seq[way], seq[not way] if flags & ACK else 0, data)))
        seq[way] += len(data) + (1 if flags & (SYN | FIN) else 0)

    say(True, SYN)
    say(False, SYN | ACK)
    say(True, ACK)
    for way, data in turns:
        say(way, PSH | ACK, data)
    if close:
        say(True, FIN | ACK)
        say(False, FIN | ACK)
        say(True, ACK)
    return out


def dns_name(name: str) -> bytes:
    return b"".join(bytes([len(x)]) + x.encode() for x in name.split(".") if x) + b"\0"


def dns_query(txid: int, name: str) -> bytes:
    return struct.pack("!HHHHHH", txid, 0x0100, 1, 0, 0, 0) + dns_name(name) + struct.pack("!HH", 1, 1)


def dns_response(txid: int, name: str, address: str, code: int = 0) -> bytes:
    answer = struct.pack("!HHHIH", 0xC00C, 1, 1, 300, 4) + ipaddress.ip_address(address).packed
    return struct.pack("!HHHHHH", txid, 0x8180 | code, 1, 1, 0, 0) + dns_name(name) + struct.pack("!HH", 1, 1) + answer


def _block(data: bytes, n: int) -> bytes:
    return len(data).to_bytes(n, "big") + data


def client_hello(sni: str | None, ciphers: tuple[int, ...] = (0x0A0A, 0x1301, 0xC02F), alpn: tuple[str, ...] = ("h2",)) -> bytes:
    """A handshake message, without its record."""
    ext = b""
    if sni:
        ext += struct.pack("!H", 0) + _block(_block(b"\0" + _block(sni.encode(), 2), 2), 2)
    ext += struct.pack("!H", 10) + _block(_block(struct.pack("!HHH", 0x0A0A, 29, 23), 2), 2)
    ext += struct.pack("!H", 11) + _block(_block(b"\0", 1), 2)
    ext += struct.pack("!H", 16) + _block(_block(b"".join(_block(a.encode(), 1) for a in alpn), 2), 2)
    ext += struct.pack("!H", 43) + _block(_block(struct.pack("!HH", 0x0304, 0x0303), 1), 2)
    body = struct.pack("!H", 0x0303) + bytes(range(32)) + _block(b"s" * 8, 1) + _block(b"".join(struct.pack("!H", c) for c in ciphers), 2) + _block(b"\0", 1) + _block(ext, 2)
    return b"\x01" + _block(body, 3)


def server_hello(cipher: int = 0x1301, selected: int | None = 0x0304) -> bytes:
    ext = struct.pack("!H", 43) + _block(struct.pack("!H", selected), 2) if selected else b""
    body = struct.pack("!H", 0x0303) + bytes(32) + _block(b"", 1) + struct.pack("!H", cipher) + b"\0" + _block(ext, 2)
    return b"\x02" + _block(body, 3)


def tls_record(kind: int, body: bytes) -> bytes:
    return bytes([kind, 3, 3]) + _block(body, 2)


def tls_talk(sni: str | None) -> list[tuple[bool, bytes]]:
    hello = tls_record(0x16, client_hello(sni))
    return [(True, hello[:40]), (True, hello[40:]), (False, tls_record(0x16, server_hello())), (True, tls_record(0x14, b"\x01")), (True, tls_record(0x17, b"x" * 30)), (False, tls_record(0x17, b"y" * 90))]


def ssh_packet(message: bytes) -> bytes:
    pad = 4 + (8 - (5 + len(message) + 4) % 8) % 8
    return _block(bytes([pad]) + message + b"\0" * pad, 4)


def ssh_kexinit(cookie: bytes, lists: list[str]) -> bytes:
    return b"\x14" + cookie + b"".join(_block(x.encode(), 4) for x in lists) + b"\0" + bytes(4)


def ssh_talk(cookie: bytes = bytes(range(14)) + b"\x15\x1a") -> list[tuple[bool, bytes]]:
    lists = ["curve25519-sha256,ecdh-sha2-nistp256", "ssh-ed25519", "aes128-ctr", "aes128-ctr", "hmac-sha2-256", "hmac-sha2-256", "none", "none", "", ""]
    kex = ssh_packet(ssh_kexinit(cookie, lists))
    return [
        (True, b"SSH-2.0-Client_1.0 first try\r\n"), (False, b"SSH-2.0-Server_2.1\r\n"), (False, kex), (True, kex), (True, ssh_packet(b"\x1e" + _block(b"e" * 8, 4))),
        (False, ssh_packet(b"\x1f" + _block(b"key", 4) + _block(b"f", 4) + _block(b"sig", 4)) + ssh_packet(b"\x15")), (True, ssh_packet(b"\x15")),
    ]


def http_talk() -> list[tuple[bool, bytes]]:
    ask = lambda path: f"GET {path} HTTP/1.1\r\nHost: shop.example\r\nUser-Agent: probe/1\r\n\r\n".encode()
    say = lambda code, body: f"HTTP/1.1 {code} Fine\r\nContent-Type: text/plain\r\nContent-Length: {len(body)}\r\n\r\n{body}".encode()
    return [(True, ask("/a") + ask("/b")), (True, ask("/c")), (False, say(200, "one")), (False, say(404, "second") + say(500, ""))]


def sample_capture() -> list[tuple[int, bytes]]:
    """Connections of every kind, in order of time."""
    out = talk(http_talk(), ("10.0.0.1", 40001), ("198.18.0.9", 80), 0)
    out += talk(tls_talk("shop.example"), ("10.0.0.2", 40002), ("198.18.0.9", 443), 500)
    out += talk(tls_talk(None), ("2001:db8::2", 40003), ("2001:db8::9", 8443), 700)
    out += talk(ssh_talk(), ("10.0.0.3", 40004), ("198.18.0.9", 22), 900)
    for i, (q, r) in enumerate([("a.example", "198.18.1.1"), ("b.test", "198.18.1.2")]):
        out.append((2000 + i * 100, udp("10.0.0.4", 40005, "198.18.0.53", 53, dns_query(7 + i, q))))
        out.append((2050 + i * 100, udp("198.18.0.53", 53, "10.0.0.4", 40005, dns_response(7 + i, q, r), vlan=12)))
    out.append((2500, udp("10.0.0.4", 40005, "198.18.0.53", 53, dns_query(99, "unanswered.example"))))
    out.append((3000, tcp("10.0.0.8", 1, "10.0.0.9", 2, ACK, 5, 5, b"middle")))
    out.append((3100, ethernet(b"\0" * 40, 0x0806)))
    return sorted(out, key=lambda x: x[0])


def _varint(n: int) -> bytes:
    return bytes([n]) if n < 64 else struct.pack("!H", n | 0x4000) if n < 1 << 14 else struct.pack("!I", n | 0x80000000)


def quic_initial(sni: str, dcid: bytes = bytes.fromhex("8394c8f03e515708"), scid: bytes = b"\x01\x02\x03\x04", number: int = 2, version: int = 1) -> bytes:
    """A client's first datagram: one Initial packet with its hello; the tag is zero, as nothing here verifies it."""
    from packetloom.parsers.aes import encrypt_block, gcm_plain
    from packetloom.parsers.quic import initial_keys

    key, iv, header_key = initial_keys(version, dcid, True)
    hello = client_hello(sni)
    frames = b"\x06\x00" + _varint(len(hello)) + hello
    frames += bytes(max(0, 1162 - len(frames)))
    length = 4 + len(frames) + 16
    head = bytes([0xC3]) + version.to_bytes(4, "big") + _block(dcid, 1) + _block(scid, 1) + b"\0" + struct.pack("!H", length | 0x4000)
    nonce = (int.from_bytes(iv, "big") ^ number).to_bytes(12, "big")
    sealed = gcm_plain(key, nonce, frames + bytes(16)) + bytes(16)  # counter mode is its own inverse
    mask = encrypt_block(header_key, sealed[:16])
    first = head[0] ^ mask[0] & 0x0F
    hidden = bytes(a ^ b for a, b in zip(number.to_bytes(4, "big"), mask[1:], strict=False))
    return bytes([first]) + head[1:] + hidden + sealed


def quic_capture() -> list[tuple[int, bytes]]:
    a, b = ("10.0.0.6", 40006), ("198.18.0.9", 443)
    out = [(4000, udp(*a, *b, quic_initial("video.example")))]
    out.append((4100, udp(*b, *a, b"\x40" + b"\x01\x02\x03\x04" + b"z" * 40)))
    return out
