"""An FM-index of a sequence of small numbers: suffix array, wavelet matrix, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; only suffixes still tied are sorted again."""
    n = len(seq)
    bits = max(1, int(seq.max(initial=0)).bit_length())
    width = max(1, 62 // bits)  # symbols that the first sort looks at
    padded = np.concatenate((seq.astype(np.int64), np.zeros(width, np.int64)))
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << bits) | padded[k : k + n]
    order = np.argsort(key)
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    place = np.arange(n)
    rank[order] = np.maximum.accumulate(np.where(new, place, 0))
    tied = _tied(new)
    step = width
    while len(tied):
        own = order[tied]
        key = rank[own] * (n + 1) + rank[np.minimum(own + step, n)] + 1
        by = np.argsort(key)
        own, key = own[by], key[by]
        order[tied] = own
        new = np.concatenate(([True], key[1:] != key[:-1]))
        rank[own] = tied[np.maximum.accumulate(np.where(new, np.arange(len(tied)), 0))]
        tied = tied[_tied(new)]
        step *= 2
    return order


def _tied(new: np.ndarray) -> np.ndarray:
    """Places in runs of more than one; ``new`` marks where runs begin."""
    return np.flatnonzero(~(new & np.concatenate((new[1:], [True]))))


class FMIndex:
    """Index of ``seq`` with symbols from 1; 0 is put at the end as terminator."""

    def __init__(self, seq: np.ndarray, rate: int = 16) -> None:
        seq = np.concatenate((seq, [0])).astype(np.int32)
        order = suffix_array(seq)
        self.n = len(seq)
        self.bwt = seq[order - 1]
        self.levels = max(1, int(seq.max()).bit_length())
        counts = np.bincount(seq, minlength=1 << self.levels)
        begins = np.cumsum(counts) - counts
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        row = self.bwt
        for level in range(self.levels - 1, -1, -1):
            bit = ((row >> level) & 1).astype(bool)
            self.ones.append(np.concatenate(([0], np.cumsum(bit, dtype=np.int32))))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            row = np.concatenate((row[~bit], row[bit]))
        symbols = np.arange(1 << self.levels)
        self.shift = begins - self._descend(symbols, np.zeros(len(symbols), np.int64))
        self.marked = order % rate == 0
        self.mark_rank = np.cumsum(self.marked) - 1
        self.samples = order[self.marked]

    def _descend(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[k][places]
            places = np.where((symbols >> level) & 1, self.zeros[k] + ones, places - ones)
        return places

    def before(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """First row of suffixes that begin with the symbol, plus its rank before the place."""
        return self.shift[symbols] + self._descend(symbols, places)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of the patterns, one per matrix row, right-aligned with -1 before them."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n)
        high[(patterns >= 1 << self.levels).any(1)] = 0  # symbols that the sequence lacks
        alive = np.arange(len(patterns))
        for k in range(patterns.shape[1] - 1, -1, -1):
            alive = alive[(patterns[alive, k] >= 0) & (high[alive] > low[alive])]
            if len(alive) == 0:
                break
            symbols = patterns[alive, k]
            low[alive], high[alive] = self.before(symbols, low[alive]), self.before(symbols, high[alive])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin: steps back until a sampled position."""
        out = np.zeros(len(rows), np.int64)
        left, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(left):
            done = self.marked[at]
            out[left[done]] = self.samples[self.mark_rank[at[done]]] + steps
            left, at = left[~done], at[~done]
            at = self.before(self.bwt[at], at)
            steps += 1
        return out
