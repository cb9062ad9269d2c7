"""Elias-Fano coding of non-decreasing numbers, with select.

n numbers below u take about 2 + log2(u / n) bits each: the low bits are packed,
the high bits become a unary bit vector with one set bit per number. Every 256th
set bit has its place stored in 32 bits, so that select(i) scans a few words."""

from __future__ import annotations

import struct

import numpy as np

STEP = 256
_HEAD = struct.Struct("<QQB3xIII")  # n, largest, low bits, bytes of low, high, samples


def _pack(values: np.ndarray, width: int) -> bytes:
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode(values: np.ndarray) -> bytes:
    v = np.asarray(values, dtype=np.uint64)
    n, top = len(v), int(v[-1]) if len(v) else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    low_bytes = _pack(v & np.uint64((1 << low) - 1), low) if low else b""
    places = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros((int(places[-1]) + 8) // 8 * 8 if n else 0, np.uint8)
    bits[places] = 1
    high = np.packbits(bits, bitorder="little").tobytes()
    samples = places[::STEP].astype("<u4").tobytes()
    return _HEAD.pack(n, top, low, len(low_bytes), len(high), len(samples)) + low_bytes + high + samples


class Sequence:
    """Reads an encoded sequence in place. ``size`` is the bytes that it takes."""

    def __init__(self, data, at: int = 0):
        self.n, self.top, self.low, a, b, c = _HEAD.unpack_from(data, at)
        p = at + _HEAD.size
        self.lows = np.frombuffer(data, np.uint8, a, p)
        self.highs = np.frombuffer(data, np.uint8, b, p + a)
        self.samples = np.frombuffer(data, "<u4", c // 4, p + a + b)
        self.size = _HEAD.size + a + b + c

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """Place of the i-th set bit of the high part."""
        start = int(self.samples[i // STEP])
        left = i % STEP
        byte = start // 8
        first = np.unpackbits(self.highs[byte:byte + 1], bitorder="little")
        first[:start % 8] = 0
        ones = np.flatnonzero(first)
        while len(ones) <= left:
            left -= len(ones)
            byte += 1
            ones = np.flatnonzero(np.unpackbits(self.highs[byte:byte + 1], bitorder="little"))
        return byte * 8 + int(ones[left])

    def _low(self, i: int) -> int:
        if not self.low:
            return 0
        bit = i * self.low
        piece = int.from_bytes(self.lows[bit // 8:(bit + self.low + 7) // 8].tobytes(), "little")
        return piece >> bit % 8 & (1 << self.low) - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return (self.select(i) - i) << self.low | self._low(i)

    def all(self) -> np.ndarray:
        highs = np.flatnonzero(np.unpackbits(self.highs, bitorder="little"))[:self.n].astype(np.uint64) - np.arange(self.n, dtype=np.uint64)
        if not self.low:
            return highs
        bits = np.unpackbits(self.lows, bitorder="little")[:self.n * self.low].reshape(self.n, self.low)
        lows = bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low, dtype=np.uint64))
        return highs << np.uint64(self.low) | lows
