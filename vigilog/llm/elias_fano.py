"""Sorted whole numbers in about log2(range / count) + 2 bits each, searched in place."""

from __future__ import annotations

import struct

import numpy as np

_HEAD = "<qbq"


def _low_bytes(n: int, bits: int) -> int:
    return max(0, min(8, -(-(bits - max(n, 1).bit_length() + 1) // 8)))


def encode(values: np.ndarray, bits: int) -> bytes:
    """A sorted sequence of numbers below 2 ** ``bits``.

    The low bits stand in whole bytes of their own, four of them apart from the others; the rest of each
    number, plus its place, is a set bit of the upper part.
    """
    n = len(values)
    low = _low_bytes(n, bits)
    low = {3: 4, 7: 8}.get(low, low)
    values = np.ascontiguousarray(values, dtype="<u8")
    by_byte = values.view(np.uint8).reshape(n, 8)
    wide = [4, *range(4, low)] if low >= 4 else [*range(low)]
    lows = b"".join(values.astype("<u4").tobytes() if w == 4 and k == 0 else by_byte[:, w].tobytes() for k, w in enumerate(wide))
    upper = (values >> np.uint64(8 * low) if low < 8 else np.zeros(n, np.uint64)).astype(np.int64) + np.arange(n)
    marks = np.zeros(int(upper[-1]) + 1 if n else 0, np.uint8)
    marks[upper] = 1
    packed = np.packbits(marks)
    return struct.pack(_HEAD, n, low, len(packed)) + lows + packed.tobytes()


class EliasFano:
    """Such a sequence over a buffer, which may be a memory map: the low bytes are read where they lie."""

    def __init__(self, buffer, offset: int = 0):
        self.n, self.low, packed = struct.unpack_from(_HEAD, buffer, offset)
        at = offset + struct.calcsize(_HEAD)
        self.parts: list[tuple[np.ndarray, int]] = []  # with the place of their first bit
        done = 0
        while done < self.low:
            kind, size = (np.dtype("<u4"), 4) if not done and self.low >= 4 else (np.dtype(np.uint8), 1)
            self.parts.append((np.frombuffer(buffer, kind, self.n, at), 8 * done))
            at, done = at + self.n * size, done + size
        marks = np.unpackbits(np.frombuffer(buffer, np.uint8, packed, at))
        self.end = at + packed
        self.high = np.flatnonzero(marks) - np.arange(self.n)
        #: The first place of each value of the high part, so the numbers that share one lie in a known range.
        self.bucket = np.concatenate(([0], np.cumsum(np.bincount(self.high)))) if self.n else np.zeros(1, np.int64)

    def _lows(self, at) -> np.ndarray:
        found = np.zeros(1, np.uint64)
        for part, bit in self.parts:
            found = found | (part[at].astype(np.uint64) << np.uint64(bit))
        return found

    def get(self, at: np.ndarray) -> np.ndarray:
        low = self._lows(at)
        return low | (self.high[at].astype(np.uint64) << np.uint64(8 * self.low)) if self.low < 8 else low

    def all(self) -> np.ndarray:
        return self.get(slice(None)) if self.n else np.zeros(0, np.uint64)

    def find(self, values: np.ndarray, begin: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """The place of each value, -1 if absent; with ``begin`` and ``end``, only places within those are searched."""
        found = np.full(len(values), -1)
        if not self.n or not len(values):
            return found
        high = (values >> np.uint64(8 * self.low) if self.low < 8 else np.zeros(len(values), np.uint64)).astype(np.int64)
        which = np.flatnonzero(high < len(self.bucket) - 1)
        high = high[which]
        first, last = self.bucket[high], self.bucket[high + 1]
        if begin is not None:
            first, last = np.maximum(first, begin[which]), np.minimum(last, end[which])
        low = values[which] & np.uint64((1 << (8 * self.low)) - 1)
        inside = first < last
        which, first, last, low = which[inside], first[inside], last[inside] - 1, low[inside]
        while True:  # binary search of all that still have several places
            several = np.flatnonzero(first < last)
            if not len(several):
                break
            middle = (first[several] + last[several]) >> 1
            smaller = self._lows(middle) < low[several]
            first[several] = np.where(smaller, middle + 1, first[several])
            last[several] = np.where(smaller, last[several], middle)
        same = self._lows(first) == low
        found[which[same]] = first[same]
        return found
