"""An FM-index over a sequence of small integers: wavelet-matrix ranks and sampled suffix positions."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time ranks: one running count for each word of 64 bits."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    def __init__(self, seq: np.ndarray, sigma: int):
        self.height = max(1, int(sigma).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.height - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i lies on the lowest level, on the way of the symbol."""
        for k in range(self.height):
            ones = self.levels[k].rank(i)
            up = ((symbol >> (self.height - 1 - k)) & 1).astype(bool)
            i = np.where(up, self.zeros[k] + ones, i - ones)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each position, and where it lies on the lowest level."""
        symbol = np.zeros(len(i), dtype=np.int64)
        for k in range(self.height):
            bit = self.levels[k].get(i)
            ones = self.levels[k].rank(i)
            symbol = symbol * 2 + bit
            i = np.where(bit, self.zeros[k] + ones, i - ones)
        return symbol, i


def suffix_array(rank: np.ndarray) -> np.ndarray:
    """By prefix doubling. rank: first keys, of which some end every repeat (the separators differ)."""
    n, step = len(rank), 1
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    while True:
        second = np.zeros(n, dtype=np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ahead = key[order]
        fresh = np.empty(n, dtype=np.int64)
        fresh[order] = np.cumsum(np.concatenate([[0], ahead[1:] != ahead[:-1]]))
        rank, step = fresh, step * 2
        if rank[order[-1]] == n - 1 or step >= n:
            return order


class FMIndex:
    """Over runs of symbols from 1 to sigma. No match crosses the end of a run.

    Every ``every``-th suffix position is kept, and the start of each run, so that a walk
    towards a kept position never leaves its run.
    """

    def __init__(self, symbols: np.ndarray, run_start: np.ndarray, sigma: int, every: int = 8):
        """symbols: all runs, each followed by one 0. run_start: where each run begins."""
        n = len(symbols)
        first = symbols.astype(np.int64) + len(run_start)
        ends = np.flatnonzero(symbols == 0)
        first[ends] = np.arange(len(ends))
        order = suffix_array(first)
        bwt = symbols[order - 1].astype(np.int64)
        self.matrix = WaveletMatrix(bwt, sigma)
        alphabet = np.arange(sigma + 1)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(bwt, minlength=sigma + 1))[:-1]])
        self.origin = self.matrix.descend(alphabet, np.zeros(sigma + 1, dtype=np.int64))
        keep = order % every == 0
        starts = np.zeros(n, dtype=bool)
        starts[run_start] = True
        keep |= starts[order]
        self.kept, self.sample, self.n = Bits(keep), order[keep], n

    def step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.less[symbol] + self.matrix.descend(symbol, row) - self.origin[symbol]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of suffixes that begin with each pattern (right-aligned in its line): [low, high)."""
        low, high = np.zeros(len(patterns), dtype=np.int64), np.full(len(patterns), self.n, dtype=np.int64)
        width = patterns.shape[1]
        live = np.arange(len(patterns))
        for k in range(width):
            live = live[lengths[live] > k]
            if not len(live):
                break
            symbol = patterns[live, width - 1 - k]
            low[live], high[live] = self.step(symbol, low[live]), self.step(symbol, high[live])
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """The position in the sequence of each suffix row, by walking back to a kept one."""
        at = np.empty(len(row), dtype=np.int64)
        todo, walked = np.arange(len(row)), 0
        row = row.copy()
        while len(todo):
            done = self.kept.get(row[todo])
            hit = todo[done]
            at[hit] = self.sample[self.kept.rank(row[hit])] + walked
            todo = todo[~done]
            symbol, low = self.matrix.access(row[todo])
            row[todo] = self.less[symbol] + low - self.origin[symbol]
            walked += 1
        return at
