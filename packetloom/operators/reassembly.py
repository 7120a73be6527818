"""TCP streams in order, with a bounded buffer for segments that come too early."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field

_WRAP = 1 << 32
FIN, SYN, RST, ACK = 1, 2, 4, 16


def before(a: int, b: int) -> bool:
    """a < b for sequence numbers that wrap."""
    return (a - b) % _WRAP > _WRAP // 2


class TooFarOutOfOrder(Exception):
    """More segments wait for a missing one than may be kept."""


@dataclass
class Stream:
    """One direction. push() gives (pkt_id, bytes) of what has become consumable, in the order of the stream."""

    most: int = 100
    next_seq: int | None = None
    last_ack: int = 0
    fin: bool = False
    waiting: list[tuple[int, int, int, bytes]] = field(default_factory=list)

    def push(self, pkt_id: int, seq: int, ack: int, flags: int, payload: bytes) -> list[tuple[int, bytes]]:
        if flags & ACK:
            self.last_ack = ack
        if self.next_seq is None:
            if not flags & (SYN | ACK):  # it waits for the segment that says where the stream begins
                self._wait((pkt_id, seq, flags, payload))
                return []
            self.next_seq = (seq + (1 if flags & SYN else 0)) % _WRAP
            if flags & SYN:
                seq = self.next_seq
        elif flags & SYN:
            seq = (seq + 1) % _WRAP
        out: list[tuple[int, bytes]] = []
        if not self._take(pkt_id, seq, flags, payload, out):
            self._wait((pkt_id, seq, flags, payload))
            return out
        progress = True
        while progress and self.waiting:
            progress = False
            for w in list(self.waiting):
                if not before(self.next_seq, w[1]):  # no longer too early
                    self.waiting.remove(w)
                    self._take(*w, out)
                    progress = True
        return out

    def _wait(self, segment: tuple[int, int, int, bytes]) -> None:
        if len(self.waiting) >= self.most:
            raise TooFarOutOfOrder
        self.waiting.append(segment)

    def _take(self, pkt_id: int, seq: int, flags: int, payload: bytes, out: list) -> bool:
        """Consumes what is new of a segment; False if it lies in the future."""
        assert self.next_seq is not None
        if before(self.next_seq, seq):
            return False
        late = (self.next_seq - seq) % _WRAP
        end = len(payload)
        if late < end or end == 0 and late == 0:
            out.append((pkt_id, payload[late:]))
            self.next_seq = (self.next_seq + end - late) % _WRAP
            late = end
        if flags & FIN and not self.fin and late == end:
            self.fin = True
            self.next_seq = (self.next_seq + 1) % _WRAP
        return True


@dataclass
class Content:
    """Which bytes of a direction have been seen, and how gaps between them came and went.

    capacity: chunks kept at most, None for all; spans that find no room are counted in ignored.
    """

    capacity: int | None = None
    chunks: list[tuple[int, int]] = field(default_factory=list)
    most_gaps: int = 0
    ignored: int = 0
    arrivals: int = 0
    closed: dict[int, int] = field(default_factory=dict)
    opened: dict[int, int] = field(default_factory=dict)  # gaps that are there: the arrival they came with

    def insert(self, start: int, end: int) -> None:
        """Adds [start, end), joined with chunks it overlaps or touches."""
        if end <= start:
            return
        if self.capacity is not None and len(self.chunks) >= self.capacity:
            self.ignored += 1
            return
        self.arrivals += 1
        last = self.chunks[-1][1] if self.chunks else None
        i = bisect_left(self.chunks, (start, start))
        if i and self.chunks[i - 1][1] >= start:
            i -= 1
        j = i
        gone = []
        while j < len(self.chunks) and self.chunks[j][0] <= end:
            start, end = min(start, self.chunks[j][0]), max(end, self.chunks[j][1])
            gone.append(self.chunks[j][1])
            j += 1
        at_end = j == len(self.chunks)
        self.chunks[i:j] = [(start, end)]
        for e in gone:
            if (e != end or at_end) and e in self.opened:
                self.closed[e] = self.closed.get(e, 0) + self.arrivals - self.opened.pop(e)
        if not at_end:
            self.opened.setdefault(end, self.arrivals)
        elif last is not None and last not in gone:
            self.opened.setdefault(last, self.arrivals)
        if len(self.chunks) - 1 > self.most_gaps:
            self.most_gaps += 1

    @property
    def gaps(self) -> dict[int, int]:
        """By the place where a gap begins, the arrivals while it was there, with the one it came with."""
        out = dict(self.closed)
        for e, since in self.opened.items():
            out[e] = out.get(e, 0) + self.arrivals - since + 1
        return out

    @property
    def content_gaps(self) -> int:
        return max(0, len(self.chunks) - 1)

    @property
    def missed_bytes(self) -> int:
        return sum(b[0] - a[1] for a, b in zip(self.chunks, self.chunks[1:], strict=False))

    @property
    def mean_pkts_to_fill(self) -> float | None:
        g = self.gaps
        return sum(g.values()) / len(g) if g else None

    @property
    def median_pkts_to_fill(self) -> int | None:
        """The upper of two middle values."""
        v = sorted(self.gaps.values())
        return v[len(v) // 2] if v else None
