"""One shard of an n-gram language model: Elias-Fano levels in one memory map."""

from __future__ import annotations

import mmap
import zlib

import numpy as np

from vigilog.llm import elias_fano
from vigilog.llm.elias_fano import EliasFano

ORDER = 3
#: A context may have very many successors, so their part is wide; contexts of the same bits share a node, and
#: a successor's bits depend on its context, so the n-grams stay apart.
CONTEXT_BITS = 16
WORD_BITS = 30
KEY_BITS = CONTEXT_BITS + WORD_BITS
EXACT = 64
STEPS = 8  # codes for each doubling beyond EXACT


def quantised(counts: np.ndarray) -> np.ndarray:
    """8-bit codes of frequencies on a logarithmic scale; up to EXACT, the frequency itself."""
    with np.errstate(divide="ignore"):
        steep = EXACT + np.rint(STEPS * np.log2(np.maximum(counts, EXACT) / EXACT))
    return np.where(counts <= EXACT, counts, np.minimum(steep, 255)).astype(np.uint8)


def frequencies(codes: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=float)
    table[EXACT:] = EXACT * 2 ** ((table[EXACT:] - EXACT) / STEPS)
    return table[codes]


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as bytes, larger ones apart, compressed: most are 0 or 1."""
    large = np.flatnonzero(counts >= 255)
    small = np.minimum(counts, 255).astype(np.uint8).tobytes()
    return zlib.compress(np.int64(len(large)).tobytes() + counts[large].astype(np.int64).tobytes() + small, 1)


def unpack_counts(data: bytes) -> np.ndarray:
    data = zlib.decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    counts = np.frombuffer(data, np.uint8, -1, 8 + 8 * n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(data, np.int64, n, 8)
    return counts


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order with their total counts, without those of count 0."""
    every, times = np.concatenate(keys), np.concatenate(counts)
    some = times > 0
    every, times = every[some], times[some]
    order = np.argsort(every)
    every, times = every[order], times[order]
    starts = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    return every[starts], np.add.reduceat(times, starts) if len(starts) else np.zeros(0, np.int64)


class Level:
    """The n-grams of one length: contexts, a monotone pointer to the first child of each, and the children.

    A child is its context's number followed by its own word's bits, so the children of all contexts form
    one increasing sequence, and a successor is searched among its context's children only.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        contexts = keys >> np.uint64(WORD_BITS)
        first = np.flatnonzero(np.concatenate(([True], contexts[1:] != contexts[:-1]))) if len(keys) else np.zeros(0, np.int64)
        number = np.cumsum(np.bincount(first, minlength=len(keys))) - 1 if len(keys) else np.zeros(0, np.int64)
        children = (number.astype(np.uint64) << np.uint64(WORD_BITS)) | (keys & np.uint64((1 << WORD_BITS) - 1))
        pointers = np.append(first, len(keys)).astype(np.uint64)
        parts = [
            elias_fano.encode(contexts[first], CONTEXT_BITS),
            elias_fano.encode(pointers, max(1, len(keys).bit_length())),
            elias_fano.encode(children, WORD_BITS + max(1, len(first).bit_length())),
            quantised(counts).tobytes(),
        ]
        self.map = mmap.mmap(-1, max(1, sum(map(len, parts))))
        self.map.write(b"".join(parts))
        self.contexts = EliasFano(self.map)
        self.pointers = EliasFano(self.map, self.contexts.end)
        self.children = EliasFano(self.map, self.pointers.end)
        self.codes = np.frombuffer(self.map, np.uint8, len(keys), self.children.end)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The code of each n-gram, 0 if it never occurred."""
        context = self.contexts.find(keys >> np.uint64(WORD_BITS))
        known = np.flatnonzero(context >= 0)
        context = context[known]
        begin, end = self.pointers.get(context).astype(np.int64), self.pointers.get(context + 1).astype(np.int64)
        child = (context.astype(np.uint64) << np.uint64(WORD_BITS)) | (keys[known] & np.uint64((1 << WORD_BITS) - 1))
        at = self.children.find(child, begin, end)
        found = np.zeros(len(keys), np.uint8)
        found[known[at >= 0]] = self.codes[at[at >= 0]]
        return found


class Words:
    """The words of a shard with their exact counts, which the base score needs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.words, self.counts = EliasFano(elias_fano.encode(keys, 64)), counts

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.words.find(keys)
        found = np.zeros(len(keys), np.int64)
        found[at >= 0] = self.counts[at[at >= 0]]
        return found
