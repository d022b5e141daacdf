"""Elias-Fano coding of non-decreasing numbers, with a select directory."""

from __future__ import annotations

import numpy as np

#: Set bits between entries of the select directory.
SAMPLE = 256
_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], np.uint8)


class EliasFano:
    """n numbers below or equal to `top` in about n * (2 + log2(top / n)) bits.

    Each number's low bits are packed side by side; its high part is a set bit in a unary bit vector, at place
    high + index. `samples` holds the byte of every SAMPLE-th set bit and how many set bits precede that byte.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.width, self.low, self.high, self.samples = n, width, low, high, samples

    @classmethod
    def encode(cls, values: np.ndarray, top: int) -> EliasFano:
        values, n = np.asarray(values, np.int64), len(values)
        width = max(0, int(top // max(n, 1)).bit_length() - 1)
        step = 1 << 16  # a multiple of 8, so that the packed blocks join at whole bytes
        low = [np.packbits(((values[at : at + step, None] >> np.arange(width)) & 1).astype(np.uint8).ravel(), bitorder="little") for at in range(0, n, step)]
        places = (values >> width) + np.arange(n)
        unary = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        unary[places] = 1
        high = np.packbits(unary, bitorder="little")
        before = np.concatenate([[0], np.cumsum(_POPCOUNT[high])]).astype(np.int64)
        at = places[::SAMPLE] >> 3
        return cls(n, width, np.concatenate([np.zeros(0, np.uint8), *low]), high, np.stack([at, before[at]], axis=1).astype("<i8"))

    def _low(self, i: int) -> int:
        if not self.width:
            return 0
        first = i * self.width
        data = self.low[first >> 3 : (first + self.width + 7) >> 3].tobytes()
        return (int.from_bytes(data, "little") >> (first & 7)) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        """The i-th number, from the directory and at most a few bytes after it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, seen = (int(x) for x in self.samples[i // SAMPLE])
        while seen + (ones := int(_POPCOUNT[self.high[at]])) <= i:
            seen, at = seen + ones, at + 1
        byte, want = int(self.high[at]), i - seen
        for bit in range(8):
            if byte >> bit & 1:
                if not want:
                    return (at * 8 + bit - i) << self.width | self._low(i)
                want -= 1
        raise AssertionError("unreachable")

    def all(self) -> np.ndarray:
        """Every number in order."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        low = np.unpackbits(self.low, bitorder="little")[: self.n * self.width].reshape(self.n, self.width).astype(np.int64)
        return (high.astype(np.int64) << self.width) | (low << np.arange(self.width)).sum(axis=1)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.width, len(self.low), len(self.high), len(self.samples)], "<i8")
        return b"".join(x.tobytes() for x in (head, self.low, self.high, self.samples.astype("<i8")))

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, width, low, high, samples = (int(x) for x in np.frombuffer(data, "<i8", 5))
        at = 40
        parts = []
        for size in (low, high):
            parts.append(np.frombuffer(data, np.uint8, size, at))
            at += size
        return cls(n, width, *parts, np.frombuffer(data, "<i8", 2 * samples, at).reshape(samples, 2))
