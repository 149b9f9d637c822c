"""Elias-Fano coding of non-decreasing sequences, with select.

n values below u take about n * (2 + log2(u / n)) bits: the low bits are packed,
the high bits are a unary bit vector. ``select(i)`` starts from a 32-bit sample of
every 256th one bit.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
_HEAD = struct.Struct("<QQBxxxxxxx")


class EliasFano:
    def __init__(self, n: int, universe: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.universe, self.low_bits, self.low, self.high, self.samples = n, universe, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n = len(values)
        if n and np.any(values[1:] < values[:-1]):
            raise ValueError("values must not decrease")
        universe = int(values[-1]) + 1 if n else 1
        low_bits = max(0, (universe // max(1, n)).bit_length() - 1)
        if low_bits:
            bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        else:
            low = np.zeros(0, np.uint8)
        ones = ((values >> np.uint64(low_bits)) + np.arange(n, dtype=np.uint64)).astype(np.int64)
        flags = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        flags[ones] = 1
        return cls(n, universe, low_bits, low, np.packbits(flags, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def _low(self, a: int, b: int) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(b - a, np.uint64)
        first = a * self.low_bits
        last = b * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (last + 7) // 8], bitorder="little")[first % 8 :][: last - first]
        return (bits.reshape(-1, self.low_bits).astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def slice(self, a: int, b: int) -> np.ndarray:
        """Values a..b-1, reading only the blocks that hold them."""
        if a >= b:
            return np.zeros(0, np.int64)
        block = a // SAMPLE
        begin = int(self.samples[block])
        stop = (b - 1) // SAMPLE + 1
        end = int(self.samples[stop]) if stop < len(self.samples) else len(self.high) * 8
        flags = np.unpackbits(self.high[begin // 8 : (end + 7) // 8], bitorder="little")
        ones = np.flatnonzero(flags) + begin // 8 * 8
        ones = ones[ones >= begin][a - block * SAMPLE : b - block * SAMPLE]
        high = (ones - np.arange(a, b)).astype(np.uint64)
        return ((high << np.uint64(self.low_bits)) | self._low(a, b)).astype(np.int64)

    def select(self, i: int) -> int:
        """Value number ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.slice(i, i + 1)[0])

    def to_bytes(self) -> bytes:
        parts = [self.low.tobytes(), self.high.tobytes(), self.samples.tobytes()]
        return _HEAD.pack(self.n, self.universe, self.low_bits) + struct.pack("<QQQ", *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, universe, low_bits = _HEAD.unpack_from(data)
        sizes = struct.unpack_from("<QQQ", data, _HEAD.size)
        at, parts = _HEAD.size + 24, []
        for size in sizes:
            parts.append(data[at : at + size])
            at += size
        return cls(n, universe, low_bits, np.frombuffer(parts[0], np.uint8), np.frombuffer(parts[1], np.uint8), np.frombuffer(parts[2], "<u4"))
