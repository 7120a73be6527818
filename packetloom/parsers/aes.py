"""AES-128 encryption of single blocks, and counter mode as GCM uses it. Tables come from the field's arithmetic."""

from __future__ import annotations

from functools import lru_cache


def _double(x: int) -> int:
    return (x << 1 ^ 0x11B if x & 0x80 else x << 1) & 0xFF


def _boxes() -> bytes:
    log, power, x = {}, [], 1
    for i in range(255):
        power.append(x)
        log[x] = i
        x ^= _double(x)  # times 3, a generator
    box = []
    for v in range(256):
        inverse = power[(255 - log[v]) % 255] if v else 0
        out = inverse
        for _ in range(4):
            inverse = (inverse << 1 | inverse >> 7) & 0xFF
            out ^= inverse
        box.append(out ^ 0x63)
    return bytes(box)


_BOX = _boxes()
_TWICE = bytes(_double(x) for x in range(256))
#: Where each byte of the state comes from when rows are shifted.
_SHIFT = [(i + 4 * (i % 4)) % 16 for i in range(16)]


@lru_cache(64)
def _round_keys(key: bytes) -> list[bytes]:
    words = [key[i : i + 4] for i in range(0, 16, 4)]
    factor = 1
    for i in range(4, 44):
        w = words[-1]
        if i % 4 == 0:
            w = bytes(_BOX[b] for b in w[1:] + w[:1])
            w = bytes([w[0] ^ factor]) + w[1:]
            factor = _double(factor)
        words.append(bytes(a ^ b for a, b in zip(w, words[-4], strict=True)))
    return [b"".join(words[i : i + 4]) for i in range(0, 44, 4)]


def encrypt_block(key: bytes, block: bytes) -> bytes:
    keys = _round_keys(key)
    state = [a ^ b for a, b in zip(block, keys[0], strict=True)]
    for turn in range(1, 11):
        state = [_BOX[state[i]] for i in _SHIFT]
        if turn < 10:
            mixed = []
            for c in range(0, 16, 4):
                col = state[c : c + 4]
                every = col[0] ^ col[1] ^ col[2] ^ col[3]
                mixed += [col[i] ^ every ^ _TWICE[col[i] ^ col[(i + 1) % 4]] for i in range(4)]
            state = mixed
        state = [a ^ b for a, b in zip(state, keys[turn], strict=True)]
    return bytes(state)


def gcm_plain(key: bytes, nonce: bytes, sealed: bytes) -> bytes:
    """The plain text of a message sealed with a 16-byte tag; the tag is not verified."""
    text = sealed[:-16]
    out = bytearray()
    for i in range(0, len(text), 16):
        pad = encrypt_block(key, nonce + (i // 16 + 2).to_bytes(4, "big"))
        out += bytes(a ^ b for a, b in zip(text[i : i + 16], pad, strict=False))
    return bytes(out)
