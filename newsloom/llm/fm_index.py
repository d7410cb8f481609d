"""FM-index over a sequence of small integers: suffix order, wavelet-tree ranks, sampled positions (NumPy)."""

from __future__ import annotations

import numpy as np


class BitRank:
    """A bit vector with the number of ones before any position."""

    def __init__(self, bits: np.ndarray):
        pad = np.zeros(-len(bits) % 64 + 64, np.uint8)
        self.words = np.packbits(np.concatenate([bits.astype(np.uint8), pad]), bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])[:-1]

    def rank(self, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & below)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletTree:
    """Symbols by bit level, highest first, each level stably split into zeros and ones."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = []
        for level in reversed(range(max(1, int(sigma - 1).bit_length()))):
            bits = (symbols >> level) & 1 == 1
            self.levels.append((level, BitRank(bits), int(len(symbols) - bits.sum())))
            symbols = np.concatenate([symbols[~bits], symbols[bits]])

    def follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Place of position ``i`` in the part of the last level that holds ``symbol``."""
        for level, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where((symbol >> level) & 1 == 1, zeros + ones, i - ones)
        return i

    def symbol_at(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and its place in the last level."""
        symbol = np.zeros(len(i), np.int64)
        for _, bits, zeros in self.levels:
            one, ones = bits.get(i), bits.rank(i)
            symbol = symbol << 1 | one
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes in their order, by prefix doubling."""
    n = len(symbols)
    rank, step = symbols.astype(np.int64), 1
    while True:
        nxt = np.zeros(n, np.int64)
        if step < n:
            nxt[:-step] = rank[step:] + 1
        key = rank * (max(int(rank.max()), n) + 2) + nxt
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class FMIndex:
    """Index of ``symbols`` (0 is the unique last one, all below ``sigma``); every ``sample``-th position is kept."""

    def __init__(self, symbols: np.ndarray, sigma: int, sample: int = 16):
        order = suffix_order(symbols)
        self.n = len(symbols)
        self.tree = WaveletTree(symbols[order - 1].astype(np.int64), sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.base = self.tree.follow(np.arange(sigma), np.zeros(sigma, np.int64))
        marked = order % sample == 0
        self.marked, self.samples = BitRank(marked), order[marked]

    def _step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.tree.follow(symbol, i) - self.base[symbol]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [low, high) of all phrases (rows padded on the right) by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(phrases.shape[1] if len(phrases) else 0):
            at = np.flatnonzero((lengths > back) & (low < high))
            if not len(at):
                break
            symbol = phrases[at, lengths[at] - 1 - back]
            low[at], high[at] = self._step(symbol, low[at]), self._step(symbol, high[at])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: walk back to a sampled one."""
        out, walking, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.astype(np.int64)
        while len(walking):
            done = self.marked.get(rows)
            out[walking[done]] = self.samples[self.marked.rank(rows[done])] + steps
            rows, walking, steps = rows[~done], walking[~done], steps + 1
            symbol, place = self.tree.symbol_at(rows)
            rows = self.first[symbol] + place - self.base[symbol]
        return out
