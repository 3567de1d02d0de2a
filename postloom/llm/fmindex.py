"""A full-text index over words: suffix order, Burrows-Wheeler transform in a wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling; after the first rounds only ties are sorted again."""
    n = len(symbols)
    if n < 2:
        return np.arange(n)
    rank = symbols.astype(np.int64)
    width, base = 1, int(rank.max()) + 2
    padded = np.zeros(n + 2, dtype=np.int64)
    padded[:n] = rank + 1
    if base < 2**20:
        key, width = (padded[:n] * base + padded[1 : n + 1]) * base + padded[2 : n + 2], 3
    else:
        key = padded[:n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    starts = np.concatenate(([True], ordered[1:] != ordered[:-1]))
    rank = np.empty(n, dtype=np.int64)
    # The rank of a group is the place of its first member, so ranks of settled suffixes never change.
    rank[order] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    while True:
        shared = ~(starts & np.concatenate((starts[1:], [True])))
        places = np.flatnonzero(shared)
        if not len(places):
            return order
        at = order[places]
        after = np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + 1, 0)
        again = np.lexsort((after, rank[at]))
        at, after = at[again], after[again]
        group = rank[at]
        order[places] = at
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])))
        starts[places] = new
        rank[at] = np.maximum.accumulate(np.where(new, places, 0))
        width *= 2


class WaveletMatrix:
    """Counts a symbol before a place, for many symbols and places at once."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels, self.ones, self.zeros = levels, [], []
        current = symbols
        for level in range(levels - 1, -1, -1):
            bit = (current >> level) & 1
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(int(len(bit) - self.ones[-1][-1]))
            current = np.concatenate((current[bit == 0], current[bit == 1]))

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The place in the last level; the difference of two places of a symbol is its count between them."""
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[k][i]
            i = np.where((symbol >> level) & 1, self.zeros[k] + ones, i - ones)
        return i

    def symbol_at(self, i: np.ndarray) -> np.ndarray:
        symbol = np.zeros(len(i), dtype=np.int64)
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            here = self.ones[k][i]
            bit = self.ones[k][i + 1] - here
            symbol |= bit.astype(np.int64) << level
            i = np.where(bit == 1, self.zeros[k] + here, i - here)
        return symbol


class FMIndex:
    """Index of texts given as one array of symbols above 0, with a 0 after each text."""

    def __init__(self, before: np.ndarray, kept: np.ndarray, position: np.ndarray):
        """From its stored parts: the symbol before each suffix in order, which suffixes have their position kept, and these positions."""
        self.n = n = len(before)
        before = before.astype(np.int64)
        levels = max(1, int(before.max()).bit_length()) if n else 1
        self.wavelet = WaveletMatrix(before, levels)
        counts = np.bincount(before, minlength=(1 << levels) + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))[: (1 << levels) + 1]
        self.kept = kept
        self.kept_before = np.concatenate(([0], np.cumsum(kept, dtype=np.int32)))
        self.position = position

    @staticmethod
    def parts(symbols: np.ndarray, sample: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What is to be stored of the index of ``symbols``; sorting the suffixes is most of the work."""
        symbols = symbols.astype(np.int64)
        n = len(symbols)
        ends = symbols == 0
        n_ends = int(ends.sum())
        distinct = symbols + n_ends
        distinct[ends] = np.arange(n_ends)  # each end is a symbol of its own: suffixes of different texts are never equal
        order = suffix_order(distinct)
        starts = np.zeros(n, dtype=bool)
        starts[0] = n > 0
        starts[1:] = ends[:-1]
        kept = (order % sample == 0) | starts[order]
        return (symbols[order - 1] if n else symbols), kept, order[kept]

    @classmethod
    def of(cls, symbols: np.ndarray, sample: int = 32) -> FMIndex:
        return cls(*cls.parts(symbols, sample))

    def _back(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.wavelet.place(symbol, i) - self.wavelet.place(symbol, np.zeros(len(i), dtype=np.int64))

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern row, from, to) of the patterns that occur; all patterns have one length and symbols above 0."""
        rows = np.arange(len(patterns))
        low, high = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), self.n, dtype=np.int64)
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[rows, column]
            low, high = self._back(symbol, low), self._back(symbol, high)
            alive = high > low
            rows, low, high = rows[alive], low[alive], high[alive]
            if not len(rows):
                break
        return rows, low, high

    def locate(self, i: np.ndarray) -> np.ndarray:
        """Text positions of places in suffix order, walked back to the next sampled one."""
        result, open_, steps = np.zeros(len(i), dtype=np.int64), np.arange(len(i)), 0
        while len(open_):
            known = self.kept[i]
            result[open_[known]] = self.position[self.kept_before[i[known]]] + steps
            open_, i = open_[~known], i[~known]
            if len(open_):
                i, steps = self._back(self.wavelet.symbol_at(i), i), steps + 1
        return result
