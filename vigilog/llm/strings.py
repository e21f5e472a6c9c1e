"""Hashes of words and character runs of many texts at once, in numpy."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

FACTOR = 0x9E3779B97F4A7C55  # odd, so it has an inverse modulo 2 ** 64
INVERSE = pow(FACTOR, -1, 1 << 64)
PIECE = 1 << 21

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        for k, factor in enumerate((FACTOR, INVERSE)):
            steps = np.full(2 * n + 1, factor, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values in order, and how often each occurs."""
    values = np.sort(values)
    starts = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[starts], np.diff(np.append(starts, len(values)))


class Rolling:
    """64-bit hashes of any runs of a sequence of codes, from one pass over it."""

    def __init__(self, codes: np.ndarray):
        powers, self.inverse = _grown(len(codes))
        self.prefix = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers[: len(codes)], out=self.prefix[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        found = (self.prefix[ends] - self.prefix[starts]) * self.inverse[starts]
        return mixed(found + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def edges(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    steps = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    return steps[::2], steps[1::2]


def gathered(sizes: Iterable[int], most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts that together have about ``most`` characters, one text at least."""
    start, total, at = 0, 0, 0
    for at, size in enumerate(sizes):
        if total and total + size > most:
            yield start, at
            start, total = at, 0
        total += size
    if total or start <= at:
        yield start, at + 1


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and each text's first word (one more entry at the end)."""
    data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, firsts, count = [], np.zeros(len(texts) + 1, np.int64), 0
    for low, high in gathered(map(len, data)):
        codes = np.frombuffer(b" ".join(data[low:high]) + b" ", np.uint8)
        starts, ends = edges(~_SPACE[codes])
        rolling = Rolling(_LOWER[codes])
        hashes.append(rolling.runs(starts, ends))
        offsets = np.cumsum([0, *[len(d) + 1 for d in data[low:high]]])
        firsts[low : high + 1] = count + np.searchsorted(starts, offsets)
        count += len(starts)
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), firsts


def sequence_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive word hashes."""
    size = len(words) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    found = np.full(size, n, np.uint64)
    for k in range(n):
        found = mixed(found * np.uint64(FACTOR) + words[k : k + size])
    return found
