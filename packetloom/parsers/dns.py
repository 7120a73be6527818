"""DNS transactions over UDP and TCP."""

from __future__ import annotations

import ipaddress
import json

from packetloom.parsers.base import Parser, Probe, Reader, Truncated, register

#: Names of response codes and record types. Fixed values.
CODES = ("NoError", "FormatError", "ServerFailure", "NameError", "NotImplemented", "Refused")
KINDS = {1: "A", 2: "Ns", 5: "Cname", 6: "Soa", 12: "Ptr", 15: "Mx", 16: "Txt", 28: "Aaaa", 33: "Srv"}


def read_name(data: bytes, at: int) -> tuple[str, int]:
    """A name and where it ends; pointers may only go back."""
    labels, end, last = [], None, at
    while True:
        if at >= len(data):
            raise Truncated("name")
        n = data[at]
        if n >= 0xC0:
            if at + 1 >= len(data):
                raise Truncated("pointer")
            to = (n & 0x3F) << 8 | data[at + 1]
            end = at + 2 if end is None else end
            if to >= last:
                raise ValueError("pointer forward")
            at = last = to
            continue
        if n >= 0x40:
            raise ValueError("label type")
        if n == 0:
            return ".".join(labels), at + 1 if end is None else end
        if at + 1 + n > len(data):
            raise Truncated("label")
        labels.append(data[at + 1 : at + 1 + n].decode("utf-8", "replace"))
        at += 1 + n


def _record(r: Reader) -> dict:
    name, r.at = read_name(r.data, r.at)
    kind, _, ttl = r.uint(2), r.uint(2), r.uint(4)
    size = r.uint(2)
    start = r.at
    raw = r.take(size)
    said = KINDS.get(kind, "Unknown")
    if said == "A" and size == 4 or said == "Aaaa" and size == 16:
        text = str(ipaddress.ip_address(raw))
    elif said in ("Ns", "Cname", "Ptr"):
        text = read_name(r.data, start)[0]
    elif said == "Mx":
        text = json.dumps({"preference": int.from_bytes(raw[:2], "big"), "exchange": read_name(r.data, start + 2)[0]})
    elif said == "Srv":
        q = Reader(raw)
        text = json.dumps({"priority": q.uint(2), "weight": q.uint(2), "port": q.uint(2), "target": read_name(r.data, start + 6)[0]})
    elif said == "Soa":
        mname, at = read_name(r.data, start)
        rname, at = read_name(r.data, at)
        q = Reader(r.data, at)
        text = json.dumps({"primary_ns": mname, "mailbox": rname, **{k: q.uint(4) for k in ("serial", "refresh", "retry", "expire", "minimum_ttl")}})
    elif said == "Txt":
        q, parts = Reader(raw), []
        while q.left:
            parts.append(q.block(1).decode("utf-8", "replace"))
        text = "".join(parts)
    else:
        said, text = "Unknown", raw.hex()
    return {"name": name, "kind": said, "rdata": text, "ttl": ttl}


def read_message(data: bytes) -> dict:
    """id, is_response, and the fields of a query or response; raises for anything else."""
    r = Reader(data)
    txid, flags = r.uint(2), r.uint(2)
    counts = [r.uint(2) for _ in range(4)]
    names = []
    for _ in range(counts[0]):
        name, r.at = read_name(data, r.at)
        r.take(4)
        names.append(name)
    lists = [[_record(r) for _ in range(n)] for n in counts[1:]]
    if not flags & 0x8000:
        return {"id": txid, "is_response": False, "body": {"num_questions": counts[0], "recursion_desired": bool(flags & 0x100), "queries": names}}
    code = flags & 15
    return {"id": txid, "is_response": True, "body": {
        "response_code": CODES[code] if code < len(CODES) else f"Reserved({code})", "authoritative": bool(flags & 0x400), "recursion_available": bool(flags & 0x80),
        "num_answers": counts[1], "num_additional": counts[3], "num_nameservers": counts[2], "answers": lists[0], "nameservers": lists[1], "additionals": lists[2],
    }}


@register
class Dns(Parser):
    protocol = "dns"

    def __init__(self) -> None:
        self.udp = True
        self.stream = {True: b"", False: b""}
        self.open: dict[int, list[dict]] = {}

    def probe(self, data, to_server, ports, udp):
        self.udp = udp
        if 137 in ports:
            return Probe.NOT_FOR_US
        if not udp:
            if len(data) < 2 or int.from_bytes(data[:2], "big") + 2 > len(data):
                return Probe.UNSURE if len(data) < 14 else Probe.NOT_FOR_US
            data = data[2 : 2 + int.from_bytes(data[:2], "big")]
        try:
            m = read_message(data)
        except (ValueError, IndexError):
            return Probe.NOT_FOR_US
        b = m["body"]
        return Probe.CERTAIN if (b["answers"] if m["is_response"] else b["queries"]) else Probe.UNSURE

    def feed(self, data, to_server):
        if self.udp:
            return self._message(data)
        out = []
        buffer = self.stream[to_server] + data
        while len(buffer) >= 2 and len(buffer) >= 2 + (n := int.from_bytes(buffer[:2], "big")):
            out += self._message(buffer[2 : 2 + n])
            buffer = buffer[2 + n :]
        self.stream[to_server] = buffer
        return out

    def _message(self, data: bytes) -> list[dict]:
        try:
            m = read_message(data)
        except (ValueError, IndexError):
            return []
        mine, other = ("response", "query") if m["is_response"] else ("query", "response")
        same = self.open.setdefault(m["id"], [])
        half = next((s for s in same if s[mine] is None), None)
        if half is None:
            same.append({"transaction_id": m["id"], mine: m["body"], other: None})
            return []
        same.remove(half)
        return [half | {mine: m["body"]}]

    def drain(self):
        left = [s for same in self.open.values() for s in same]
        self.open.clear()
        return left
