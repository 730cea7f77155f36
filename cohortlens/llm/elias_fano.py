"""Elias-Fano coding of a non-decreasing sequence of integers, with select."""

from __future__ import annotations

import struct

import numpy as np

#: Every how many elements the place of an upper bit is stored for select.
SAMPLE = 256
_HEAD = struct.Struct("<4sQQQB3x")
_MAGIC = b"EFS1"
_ONES = np.array([bin(b).count("1") for b in range(256)], np.uint8)


def encode(values: np.ndarray, universe: int | None = None) -> bytes:
    """Bytes of ``values`` (non-negative, non-decreasing): about log2(u/n) + 2 bits each."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    universe = max(universe or 0, top)
    low = max(0, (universe // n).bit_length() - 1) if n else 0
    bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    lower = np.packbits(bits.reshape(-1), bitorder="little")
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros((int(places[-1]) if n else 0) + 1, np.uint8)
    upper[places] = 1
    upper = np.packbits(upper, bitorder="little")
    samples = places[::SAMPLE].astype("<u4") if n and places[-1] < 2**32 else places[::SAMPLE].astype("<u8")
    head = _HEAD.pack(_MAGIC, n, len(lower), len(upper), low | (128 if samples.itemsize == 8 else 0))
    return head + lower.tobytes() + upper.tobytes() + samples.tobytes()


class EliasFano:
    """A sequence over encoded bytes (or a memory map of them)."""

    def __init__(self, data):
        magic, self.n, n_lower, n_upper, flags = _HEAD.unpack_from(data, 0)
        if magic != _MAGIC:
            raise ValueError("not an Elias-Fano sequence")
        self.low = flags & 127
        at = _HEAD.size
        self.lower = np.frombuffer(data, np.uint8, n_lower, at)
        self.upper = np.frombuffer(data, np.uint8, n_upper, at + n_lower)
        kind = "<u8" if flags & 128 else "<u4"
        self.samples = np.frombuffer(data, kind, -(-self.n // SAMPLE), at + n_lower + n_upper)

    def __len__(self) -> int:
        return self.n

    def select(self, start: int, end: int) -> np.ndarray:
        """Elements ``start`` to ``end`` (exclusive), from the sample before ``start`` on."""
        if not 0 <= start <= end <= self.n:
            raise IndexError(f"{start}:{end} of {self.n}")
        if start == end:
            return np.zeros(0, np.int64)
        block = start // SAMPLE
        first = int(self.samples[block]) // 8
        need = end - block * SAMPLE
        before = int(_ONES[self.upper[first] & ((1 << (int(self.samples[block]) % 8)) - 1)])
        last_block = (end - 1) // SAMPLE + 1
        stop = int(self.samples[last_block]) // 8 + 1 if last_block < len(self.samples) else len(self.upper)
        ones = np.flatnonzero(np.unpackbits(self.upper[first:stop], bitorder="little")) + first * 8
        places = ones[before : before + need][start - block * SAMPLE :]
        index = np.arange(start, end)
        out = (places - index) << self.low
        if self.low:
            b0, b1 = start * self.low // 8, -(-end * self.low // 8)
            bits = np.unpackbits(self.lower[b0:b1], bitorder="little")[start * self.low - b0 * 8 :]
            bits = bits[: (end - start) * self.low].reshape(-1, self.low).astype(np.int64)
            out = out | (bits << np.arange(self.low)).sum(1)
        return out
