"""FM-index of a training shard: wavelet matrix, backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling. Symbol 0 ends a run; each of its places counts as a different smallest symbol."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    width = 1
    while True:
        ranked = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate([[0], ranked[1:] != ranked[:-1]]))
        if n == 0 or new[order[-1]] == n - 1:
            return order
        follow = np.zeros(n, np.int64)
        follow[: n - width] = new[width:] + 1
        rank = new * (n + 1) + follow
        order = np.argsort(rank, kind="stable")
        width *= 2


class Bits:
    """A bit vector with rank in constant time: 64-bit words and a running count before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])
        self.zeros = len(bits) - int(self.before[-1])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Number of ones in [0, i)."""
        word = i >> 6
        part = self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(part)

    def at(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletTree:
    """Wavelet tree in matrix form: one bit vector for each bit of a symbol, zeros first on each level."""

    def __init__(self, symbols: np.ndarray, top: int):
        self.depth = max(1, int(top).bit_length())
        self.levels: list[Bits] = []
        current = symbols.astype(np.int64)
        for shift in range(self.depth - 1, -1, -1):
            bit = ((current >> shift) & 1).astype(np.uint8)
            self.levels.append(Bits(bit))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands in [0, i)."""
        start, end = np.zeros_like(i), i.copy()
        for level, shift in zip(self.levels, range(self.depth - 1, -1, -1), strict=True):
            one = (symbol >> shift) & 1 == 1
            s, e = level.ones(start), level.ones(end)
            start = np.where(one, level.zeros + s, start - s)
            end = np.where(one, level.zeros + e, end - e)
        return end - start

    def access(self, i: np.ndarray) -> np.ndarray:
        out, at = np.zeros_like(i), i.copy()
        for level in self.levels:
            one = level.at(at) == 1
            ones = level.ones(at)
            at = np.where(one, level.zeros + ones, at - ones)
            out = (out << 1) | one
        return out


class FMIndex:
    """Index of a sequence of symbols 1..top, with 0 as the end of each run; the last symbol must be 0."""

    def __init__(self, symbols: np.ndarray, top: int, every: int = 16):
        order = suffix_order(symbols)
        last = symbols[order - 1]  # the symbol before each suffix; before the first stands the final 0
        self.size = len(symbols)
        self.tree = WaveletTree(last, top)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))]).astype(np.int64)
        # a walk goes backwards from a hit, so the start of each run is sampled too
        kept = (order % every == 0) | (last == 0)
        self.sampled = Bits(kept.astype(np.uint8))
        self.positions = order[kept]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of `patterns` at once: the range of suffixes that start with each."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.size, np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            live = np.flatnonzero((lengths >= step) & (high > low))
            if not len(live):
                continue
            symbol = patterns[live, lengths[live] - step]
            low[live] = self.smaller[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row: step back to a sampled row and add the steps."""
        out, steps = np.full(len(rows), -1, np.int64), 0
        open_, at = np.arange(len(rows)), rows.copy()
        while len(open_):
            hit = self.sampled.at(at) == 1
            out[open_[hit]] = self.positions[self.sampled.ones(at[hit])] + steps
            open_, at = open_[~hit], at[~hit]
            symbol = self.tree.access(at)
            at = self.smaller[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return out
