"""Recompression: a run-length grammar of a sequence, and longest common extensions read from it."""

from __future__ import annotations

import numpy as np
import pandas as pd

_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _named(left: np.ndarray, right: np.ndarray, first_name: int) -> tuple[np.ndarray, int]:
    """One new symbol for each different pair, and the next free one."""
    codes, different = pd.factorize(left.astype(np.int64) << 32 | right.astype(np.int64))
    return (codes + first_name).astype(np.int32), first_name + len(different)


class Grammar:
    """Levels of a sequence of codes, each a shorter sequence of symbols that stand for the same codes.

    By turns every block of one repeated symbol, and every pair of a left and a right symbol, becomes one
    symbol; a seeded hash deals the symbols of a level to left and right. Equal symbols of a level stand for equal
    stretches. All levels lie one after the other in flat arrays; a symbol is named by its place there.
    """

    def __init__(self, codes: np.ndarray, enough: int = 16):
        codes = codes.astype(np.int32)
        name = int(codes.max(initial=-1)) + 1
        symbols, heads_of, blocks = [codes], [], []
        turn = 0
        while len(codes) > enough:
            turn += 1
            if turn % 2:
                heads = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
                counts = np.diff(np.append(heads, len(codes)))
                many = counts > 1
                if not many.any():
                    continue
                level = codes[heads]
                level[many], name = _named(level[many], counts[many], name)
            else:
                mixed = (codes.astype(np.uint64) + np.uint64(turn)) * _FACTOR
                mixed = (mixed ^ (mixed >> np.uint64(29))) * _FACTOR
                right = (mixed >> np.uint64(63)).astype(bool)
                starts = np.flatnonzero(~right[:-1] & right[1:])
                if not len(starts):
                    continue
                inside = np.zeros(len(codes), bool)
                inside[starts + 1] = True
                heads = np.flatnonzero(~inside)
                level = codes[heads]
                places = starts - np.arange(len(starts))
                level[places], name = _named(codes[starts], codes[starts + 1], name)
            symbols.append(level)
            heads_of.append(heads)
            blocks.append(bool(turn % 2))
            codes = level
        sizes = [len(level) for level in symbols]
        base = np.cumsum([0, *sizes])
        total = int(base[-1])
        self.symbol = np.concatenate(symbols)
        self.first, self.last = np.full(total, -1, np.int32), np.full(total, -1, np.int32)
        self.parent = np.zeros(total, np.int32)
        self.leads, self.ends = np.zeros(total, bool), np.zeros(total, bool)
        self.ahead, self.behind = np.ones(total, np.int32), np.ones(total, np.int32)
        self.start, self.stop = np.arange(total, dtype=np.int32), np.arange(1, total + 1, dtype=np.int32)
        for k, heads in enumerate(heads_of):
            low, high, top = int(base[k]), int(base[k + 1]), int(base[k + 2])
            tails = np.append(heads[1:], sizes[k])
            self.first[high:top], self.last[high:top] = low + heads, low + tails - 1
            self.start[high:top], self.stop[high:top] = self.start[low + heads], self.stop[low + tails - 1]
            self.parent[low:high] = high + np.repeat(np.arange(len(heads)), tails - heads)
            self.leads[low + heads] = True
            self.ends[low + tails - 1] = True
            if blocks[k]:  # how many like symbols of the block follow, this one included, and how many precede
                place = np.arange(sizes[k])
                self.ahead[low:high] = np.repeat(tails, tails - heads) - place
                self.behind[low:high] = place - np.repeat(heads, tails - heads) + 1

    def after(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far the sequence agrees with itself from ``a`` and from ``b`` on. The last code must be unique."""
        return self._agree(a, b, self.leads, self.first, self.ahead, 1)

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How far it agrees leftwards from before ``a`` and before ``b``. The first code must be unique."""
        return self._agree(a - 1, b - 1, self.ends, self.last, self.behind, -1)

    def _agree(
        self, a: np.ndarray, b: np.ndarray, outer: np.ndarray, child: np.ndarray, like: np.ndarray, way: int
    ) -> np.ndarray:
        """All pairs at once: up to equal parents, along equal symbols (whole blocks at a time), down at a difference."""
        found = np.zeros(len(a), np.int64)
        open_, i, j = np.arange(len(a)), a.astype(np.int32), b.astype(np.int32)
        while len(open_):
            up_i, up_j = self.parent[i], self.parent[j]
            up = outer[i] & outer[j] & (self.symbol[up_i] == self.symbol[up_j])
            same = self.symbol[i] == self.symbol[j]
            step = way * np.minimum(like[i], like[j])
            down_i, down_j = child[i], child[j]
            over = ~same & (down_i < 0)
            if over.any():
                found[open_[over]] = way * (i[over].astype(np.int64) - a[open_[over]])
            i = np.where(up, up_i, np.where(same, i + step, down_i))
            j = np.where(up, up_j, np.where(same, j + step, down_j))
            if over.any():
                keep = ~over
                open_, i, j = open_[keep], i[keep], j[keep]
        return found
