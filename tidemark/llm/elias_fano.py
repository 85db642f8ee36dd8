"""Elias-Fano coding of non-decreasing integers, with a select structure.

A value is cut into low bits, stored as they are, and a high part, stored in unary: bit
``(v >> low) + i`` is set for the i-th value. ``select(i)`` finds the i-th set bit from a sample
of every 256th and popcounts of the words behind it; ``span`` does so once for a row of values.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQBQQ")


def encode(values: np.ndarray) -> bytes:
    """Code ``values`` (non-decreasing, at least 0)."""
    values = np.asarray(values, np.uint64)
    n, top = len(values), int(values[-1]) if len(values) else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    bits = np.zeros(n + (top >> low) + 1, np.uint8)
    bits[(values >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    bits = np.pad(bits, (0, -len(bits) % 64))
    high = np.packbits(bits, bitorder="little")
    ones = np.flatnonzero(bits)[::SAMPLE].astype("<u4")
    shifts = np.arange(low, dtype=np.uint64)
    lows = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
    return _HEAD.pack(n, top, low, len(high), len(ones)) + high.tobytes() + ones.tobytes() + lows.tobytes()


class EliasFano:
    """Reader of what ``encode`` wrote."""

    def __init__(self, data: bytes):
        self.n, self.top, self.low, size, ones = _HEAD.unpack_from(data)
        at = _HEAD.size
        self.words = np.frombuffer(data, "<u8", size // 8, at)
        self.samples = np.frombuffer(data, "<u4", ones, at + size)
        self.lows = np.frombuffer(data, np.uint8, -(-self.n * self.low // 8), at + size + 4 * ones)

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int) -> int:
        a, b = i * self.low, (i + 1) * self.low
        part = int.from_bytes(self.lows[a // 8 : -(-b // 8)].tobytes(), "little")
        return part >> (a % 8) & ((1 << self.low) - 1)

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        bit = int(self.samples[i // SAMPLE])
        word, left = bit // 64, i % SAMPLE
        now = int(self.words[word]) >> (bit % 64) << (bit % 64)
        while (ones := now.bit_count()) <= left:
            left, word = left - ones, word + 1
            now = int(self.words[word])
        for _ in range(left):
            now &= now - 1
        place = word * 64 + (now & -now).bit_length() - 1
        return (place - i) << self.low | self._low(i)

    def span(self, a: int, b: int) -> np.ndarray:
        """The values from the a-th to before the b-th, as int64: one select by the sample before ``a``, then the unary
        bits behind it, word by word in numpy."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        if a == b:
            return np.zeros(0, np.int64)
        first = a // SAMPLE * SAMPLE
        word = int(self.samples[a // SAMPLE]) // 64
        skip = int(self.samples[a // SAMPLE]) % 64
        # bits up to the sample behind b, or to the end
        last = (b - 1) // SAMPLE + 1
        end = int(self.samples[last]) // 64 + 1 if last < len(self.samples) else len(self.words)
        ones = np.flatnonzero(np.unpackbits(self.words[word:end].view(np.uint8), bitorder="little")[skip:]) + word * 64 + skip
        high = ones[a - first : b - first] - np.arange(a, b)
        if not self.low:
            return high
        at = a * self.low
        bits = np.unpackbits(self.lows[at // 8 : -(-b * self.low // 8)], bitorder="little")[at % 8 :][: (b - a) * self.low]
        return (high << self.low) + bits.reshape(b - a, self.low).astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))

    def all(self) -> np.ndarray:
        """Every value, as int64."""
        bits = np.unpackbits(self.words.view(np.uint8), bitorder="little")
        high = np.flatnonzero(bits)[: self.n] - np.arange(self.n)
        if not self.low:
            return high
        low = np.unpackbits(self.lows, bitorder="little")[: self.n * self.low].reshape(self.n, self.low)
        return (high << self.low) + low.astype(np.int64) @ (1 << np.arange(self.low, dtype=np.int64))
