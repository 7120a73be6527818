"""HTTP/1.x requests and responses, headers only, in pipeline order."""

from __future__ import annotations

from packetloom.parsers.base import Parser, Probe, register

#: Methods, of which the first four bytes are looked for. Fixed values.
METHODS = ("OPTIONS", "GET", "HEAD", "POST", "PUT", "PATCH", "COPY", "MOVE", "DELETE", "LINK", "UNLINK", "TRACE", "WRAPPED")
_PREFIXES = tuple((m + " ")[:4].encode() for m in METHODS)
_LIMIT = 1 << 20


def _number(text: str | None) -> int | None:
    return int(text) if text and text.isascii() and text.isdigit() and len(text) < 19 else None


def _headers(lines: list[str]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if colon:
            out.setdefault(name.strip().lower(), value.strip())
    return out


@register
class Http(Parser):
    protocol = "http"

    def __init__(self) -> None:
        self.buffer = {True: b"", False: b""}
        self.body = {True: 0, False: 0}
        self.waiting: list[dict] = []
        self.depth = 0

    def probe(self, data, to_server, ports, udp):
        if udp:
            return Probe.NOT_FOR_US
        if not to_server:
            return Probe.UNSURE
        if not data.startswith(_PREFIXES):
            return Probe.NOT_FOR_US if len(data) >= 4 else Probe.UNSURE
        line = data.split(b"\r\n", 1)[0].split(b" ")
        return Probe.CERTAIN if len(line) == 3 and line[2].startswith(b"HTTP/1.") and line[0].decode("latin-1") in METHODS else Probe.UNSURE

    def feed(self, data, to_server):
        out = []
        skip = min(self.body[to_server], len(data))
        self.body[to_server] -= skip
        self.buffer[to_server] += data[skip:]
        while (end := self.buffer[to_server].find(b"\r\n\r\n")) >= 0:
            head, self.buffer[to_server] = self.buffer[to_server][:end], self.buffer[to_server][end + 4 :]
            first, *rest = head.decode("utf-8", "replace").split("\r\n")
            h = _headers(rest)
            starts = first.split(" ")
            if to_server and (len(starts) != 3 or starts[0] not in METHODS) or not to_server and not first.startswith("HTTP/1."):
                self.buffer[to_server] = b""  # content, not a message
                break
            encoding = h.get("transfer-encoding")
            common = {"content_length": _number(h.get("content-length")), "content_type": h.get("content-type"), "transfer_encoding": encoding.lower() if encoding else None}
            if to_server:
                request = {"method": starts[0], "uri": starts[1], "version": starts[2], "user_agent": h.get("user-agent"), "cookie": h.get("cookie"), "host": h.get("host"), **common}
                self.waiting.append({"request": request, "response": None, "trans_depth": self.depth})
                self.depth += 1
            else:
                code = starts[1] if len(starts) > 1 else ""
                response = {"version": starts[0], "status_code": _number(code), "status_msg": " ".join(starts[2:]), **common}
                if self.waiting:
                    out.append(self.waiting.pop(0) | {"response": response})
            n = common["content_length"] or 0
            skip = min(n, len(self.buffer[to_server]))
            self.buffer[to_server] = self.buffer[to_server][skip:]
            self.body[to_server] = n - skip
        if len(self.buffer[to_server]) > _LIMIT:
            self.lost += len(self.buffer[to_server])
            self.buffer[to_server] = b""
        return out

    def drain(self):
        left, self.waiting = self.waiting, []
        return left
