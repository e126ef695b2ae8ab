"""FLAC files in numpy: header, decoder and encoder, by the published format (RFC 9639)."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

BLOCK = 4096
# Fixed values of the format: sample rates and sample sizes by code, and the polynomials of its checksums.
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
POLY8, POLY16 = 0x07, 0x8005


def info(data: bytes) -> tuple[int, int, int, int, int]:
    """(rate, channels, bits, samples, start of the frames); the first 42 bytes are enough for all but the last."""
    at = 0
    if data[:3] == b"ID3":  # a foreign tag in front
        at = 10 + sum((b & 127) << s for b, s in zip(data[6:10], (21, 14, 7, 0)))
    if data[at : at + 4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at += 4
    found, last = None, False
    while not last and at + 4 <= len(data):
        last, kind, size = bool(data[at] & 128), data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        if kind == 0:
            x = int.from_bytes(data[at + 14 : at + 22], "big")
            found = x >> 44, (x >> 41 & 7) + 1, (x >> 36 & 31) + 1, x & (1 << 36) - 1
        at += 4 + size
    if found is None:
        raise ValueError("no stream information")
    return *found, at


class _Bits:
    """Reader of one frame's bits; ``ones`` has, per bit, the place of the next bit that is set."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8))
        self.at = 0
        self._ones: list[int] | None = None

    def take(self, n: int) -> int:
        out = 0
        for b in self.bits[self.at : self.at + n].tolist():
            out = out << 1 | b
        if len(self.bits) < self.at + n:
            raise ValueError("the stream ends inside a frame")
        self.at += n
        return out

    def signed(self, n: int) -> int:
        x = self.take(n)
        return x - (1 << n) if n and x >> (n - 1) else x

    def many(self, n: int, width: int) -> np.ndarray:
        """``n`` signed numbers of ``width`` bits."""
        if not width:
            return np.zeros(n, np.int64)
        b = self.bits[self.at : self.at + n * width].astype(np.int64).reshape(n, width)
        self.at += n * width
        x = b @ (1 << np.arange(width - 1, -1, -1, dtype=np.int64))
        return np.where(b[:, 0] > 0, x - (1 << width), x)

    def unary(self) -> int:
        start = self.at
        self.at = self._next()[start] + 1
        return self.at - 1 - start

    def _next(self) -> list[int]:
        if self._ones is None:
            n = len(self.bits)
            places = np.where(self.bits > 0, np.arange(n), n)
            self._ones = [*np.minimum.accumulate(places[::-1])[::-1].tolist(), n]
        return self._ones

    def rice(self, n: int, k: int) -> np.ndarray:
        """``n`` Rice codes: the chain of their ends is followed, all else is done side by side."""
        ones, at, step, ends = self._next(), self.at, k + 1, []
        for _ in range(n):
            p = ones[at]
            ends.append(p)
            at = p + step
        if n and at > len(self.bits):
            raise ValueError("the stream ends inside a frame")
        p = np.array(ends, np.int64)
        q = p - np.r_[self.at, p[:-1] + step][:n]
        x = q << k
        for j in range(k):
            x |= self.bits[p + 1 + j].astype(np.int64) << (k - 1 - j)
        self.at = at
        return (x >> 1) ^ -(x & 1)


def _residual(r: _Bits, size: int, order: int) -> np.ndarray:
    method = r.take(2)
    if method > 1:
        raise ValueError("unknown residual coding")
    width, parts = 4 + method, 1 << r.take(4)
    out = []
    for i in range(parts):
        n = size // parts - (order if i == 0 else 0)
        k = r.take(width)
        out.append(r.many(n, r.take(5)) if k == (1 << width) - 1 else r.rice(n, k))
    return np.concatenate(out)


def _subframe(r: _Bits, size: int, bits: int) -> np.ndarray:
    r.take(1)
    kind = r.take(6)
    waste = r.unary() + 1 if r.take(1) else 0
    bits -= waste
    if kind == 0:
        x = np.full(size, r.signed(bits), np.int64)
    elif kind == 1:
        x = r.many(size, bits)
    elif 8 <= kind <= 12:
        order = kind - 8
        head = r.many(order, bits)
        x = _integrated(head, _residual(r, size, order), order)
    elif kind >= 32:
        order = kind - 31
        head = r.many(order, bits)
        precision = r.take(4) + 1
        shift = r.signed(5)
        weights = r.many(order, precision).tolist()[::-1]
        x = _predicted(head.tolist(), _residual(r, size, order).tolist(), weights, shift)
    else:
        raise ValueError("reserved subframe")
    return x << waste


def _integrated(head: np.ndarray, rest: np.ndarray, order: int) -> np.ndarray:
    """Undo ``order`` differences: a running sum for each, from that of the first samples on."""
    for k in range(order - 1, -1, -1):
        rest = np.cumsum(np.r_[np.diff(head[: k + 1], k), rest])
    return rest


def _predicted(out: list[int], rest: list[int], weights: list[int], shift: int) -> np.ndarray:
    order = len(weights)
    if order == 1:
        w = weights[0]
        for e in rest:
            out.append(e + (w * out[-1] >> shift))
    else:
        from operator import mul

        for i, e in enumerate(rest):
            out.append(e + (sum(map(mul, weights, out[i : i + order])) >> shift))
    return np.array(out, np.int64)


def decode(data: bytes) -> tuple[np.ndarray, int]:
    """((channels, samples) in [-1, 1), rate)."""
    rate, channels, bits, total, at = info(data)
    frames = []
    done = 0
    while at + 6 <= len(data) and (not total or done < total):
        try:
            block, at = _frame(data, at, channels, bits)
        except IndexError:
            raise ValueError("the stream ends inside a frame") from None
        frames.append(block)
        done += block.shape[1]
    if total and done < total:
        raise ValueError("the stream ends too early")
    x = np.concatenate(frames, axis=1) if frames else np.zeros((channels, 0), np.int64)
    return x[:, : total or None] / 2.0 ** (bits - 1), rate


def _frame(data: bytes, at: int, channels: int, bits: int) -> tuple[np.ndarray, int]:
    start = at
    if data[at] != 0xFF or data[at + 1] & 0xFC != 0xF8:
        raise ValueError("a frame does not start where it should")
    size_code, rate_code, layout, bits_code = data[at + 2] >> 4, data[at + 2] & 15, data[at + 3] >> 4, data[at + 3] >> 1 & 7
    at += 4
    lead = data[at]
    at += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()  # the frame's number, coded like a character
    if size_code in (6, 7):
        n = size_code - 5
        size = int.from_bytes(data[at : at + n], "big") + 1
        at += n
    else:
        size = 192 if size_code == 1 else 576 << (size_code - 2) if size_code < 6 else 256 << (size_code - 8)
    at += {12: 1, 13: 2, 14: 2}.get(rate_code, 0)
    if _crc(POLY8, 8, data[start:at]) != data[at]:
        raise ValueError("a frame's header is damaged")
    at += 1
    width = SIZES.get(bits_code, bits)
    # A frame is hardly longer than its samples uncoded.
    n = layout + 1 if layout < 8 else 2
    r = _Bits(data[at : at + 2 * n * (size * (width + 1) // 8 + 64)])
    subs = [_subframe(r, size, width + ((layout == 8 and i == 1) or (layout == 9 and i == 0) or (layout == 10 and i == 1))) for i in range(n)]
    if layout == 8:
        subs[1] = subs[0] - subs[1]
    elif layout == 9:
        subs[0] = subs[0] + subs[1]
    elif layout == 10:
        mid, side = (subs[0] << 1) | (subs[1] & 1), subs[1]
        subs = [(mid + side) >> 1, (mid - side) >> 1]
    elif layout > 10:
        raise ValueError("reserved channel layout")
    end = at + -(-r.at // 8)
    if _crc(POLY16, 16, data[start:end]) != int.from_bytes(data[end : end + 2], "big"):
        raise ValueError("a frame is damaged")
    return np.stack(subs), end + 2


@lru_cache(maxsize=2)
def _table(poly: int, width: int) -> list[int]:
    out = []
    for b in range(256):
        x = b << (width - 8)
        for _ in range(8):
            x = (x << 1 ^ poly if x >> (width - 1) else x << 1) & ((1 << width) - 1)
        out.append(x)
    return out


def _crc(poly: int, width: int, data: bytes) -> int:
    t, x, mask, down = _table(poly, width), 0, (1 << width) - 1, width - 8
    for b in data:
        x = (x << 8 & mask) ^ t[x >> down ^ b]
    return x


def encode(channels: np.ndarray, rate: int) -> bytes:
    """16 bits a sample, second-order fixed prediction; values beyond full scale are clamped."""
    x = np.atleast_2d(np.asarray(channels))
    pcm = x.astype(np.int64) if np.issubdtype(x.dtype, np.integer) else np.clip(np.round(x * 32768), -32768, 32767).astype(np.int64)
    n, total = pcm.shape
    head = (rate << 44) | (n - 1) << 41 | 15 << 36 | total
    stream = BLOCK.to_bytes(2, "big") * 2 + bytes(6) + head.to_bytes(8, "big") + hashlib.md5(pcm.T.astype("<i2").tobytes()).digest()
    out = [b"fLaC", bytes([128]), len(stream).to_bytes(3, "big"), stream]
    for number, s in enumerate(range(0, total, BLOCK)):
        out.append(_encoded(pcm[:, s : s + BLOCK], number))
    return b"".join(out)


def _encoded(block: np.ndarray, number: int) -> bytes:
    n, size = block.shape
    head = bytes([0xFF, 0xF8, 0x70, (n - 1) << 4 | 0x08]) + chr(number).encode("utf-8", "surrogatepass") + (size - 1).to_bytes(2, "big")
    head += bytes([_crc(POLY8, 8, head)])
    parts = []
    for c in block:
        order = min(2, size)
        rest = np.diff(c, order) if size > order else c[:0]
        zig = (rest << 1) ^ (rest >> 63)
        k = int(min(14, max(0, np.floor(np.log2(zig.mean() + 1))))) if len(zig) else 0
        if int((zig >> k).sum()) + len(zig) * (1 + k) > 16 * size:  # not worth coding
            parts += [_fixed(2, 8), ((c[:, None] >> np.arange(15, -1, -1)) & 1).astype(np.uint8).ravel()]
            continue
        parts.append(_fixed((8 + order) << 1, 8))
        parts += [_fixed(int(v) & 0xFFFF, 16) for v in c[:order]]
        parts += [_fixed(0, 6), _fixed(k, 4)]
        q = zig >> k
        ends = np.cumsum(q + 1 + k)
        bits = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
        one = ends - k - 1
        bits[one] = 1
        for j in range(k):
            bits[one + 1 + j] = (zig >> (k - 1 - j)) & 1
        parts.append(bits)
    body = head + np.packbits(np.concatenate(parts)).tobytes()
    return body + _crc(POLY16, 16, body).to_bytes(2, "big")


def _fixed(value: int, width: int) -> np.ndarray:
    return np.array([value >> (width - 1 - i) & 1 for i in range(width)], np.uint8)
