"""A compressed FM-index over integer texts: a wavelet matrix of packed bits, searched backwards.

Texts are sorted by their first 2^ROUNDS symbols, which is exact for any pattern up to that length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

ROUNDS = 6
DEEP = (1 << ROUNDS) - 1  # the longest common prefix that is told apart


class BitVector:
    """Packed bits with a running count per 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.uint32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, low = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & ((np.uint64(1) << low) - np.uint64(1)))


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.depth = max(1, int(sigma - 1).bit_length())
        self.levels: list[BitVector] = []
        self.zeros: list[int] = []
        for level in range(self.depth - 1, -1, -1):
            bits = ((symbols >> level) & 1).astype(np.uint8)
            self.levels.append(BitVector(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        low, high = np.zeros_like(at), at.copy()
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = ((symbol >> (self.depth - 1 - k)) & 1) == 1
            low_ones, high_ones = bits.rank(low), bits.rank(high)
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low


class FMIndex:
    """Over texts of symbols >= 1; symbol 0 closes each text and no pattern holds it."""

    def __init__(self, texts: Sequence[np.ndarray]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        whole = np.zeros(int(sizes.sum()), np.int64)
        self.starts = np.cumsum(sizes) - sizes
        for t, s in zip(texts, self.starts):
            whole[s : s + len(t)] = t
        self.n = len(whole)
        self.sigma = int(whole.max()) + 1 if self.n else 1
        ranks = [np.unique(whole, return_inverse=True)[1].astype(np.int32)]
        order = np.argsort(ranks[0], kind="stable")
        for k in range(ROUNDS):
            step, last = 1 << k, ranks[-1].astype(np.int64)
            ahead = np.zeros(self.n, np.int64)
            if step < self.n:
                ahead[:-step] = last[step:] + 1
            key = last * (self.n + 1) + ahead
            order = np.argsort(key, kind="stable")
            put = np.empty(self.n, np.int64)
            put[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0])) if self.n else 0
            ranks.append(put.astype(np.int32))
        self.common = self._common(ranks, order)
        self.text_of = np.searchsorted(self.starts, order, "right") - 1
        self.bwt = WaveletMatrix(whole[order - 1], self.sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(whole, minlength=self.sigma))])
        self._minima: list[np.ndarray] | None = None

    def _common(self, ranks: list[np.ndarray], order: np.ndarray) -> np.ndarray:
        """Longest common prefixes of neighbours in sorted order, up to DEEP; zero at both ends."""
        a, b = order[:-1].copy(), order[1:].copy()
        shared = np.zeros(len(a), np.int64)
        for k in range(ROUNDS - 1, -1, -1):
            inside = (a < self.n) & (b < self.n)
            same = np.zeros(len(a), bool)
            same[inside] = ranks[k][a[inside]] == ranks[k][b[inside]]
            step = same.astype(np.int64) << k
            shared, a, b = shared + step, a + step, b + step
        return np.concatenate([[0], shared, [0]]).astype(np.uint8)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the interval of symbol + match."""
        symbol = np.where((symbol > 0) & (symbol < self.sigma), symbol, 0)
        base = self.first[symbol]
        low, high = base + self.bwt.rank(symbol, low), base + self.bwt.rank(symbol, high)
        return low, np.where(symbol > 0, high, low)

    def parent(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(low, high, length): the widest interval of the next shorter match, cut at its right end."""
        if self._minima is None:
            self._minima = [self.common]
            while (1 << len(self._minima)) <= len(self.common):
                last, half = self._minima[-1], 1 << len(self._minima) - 1
                self._minima.append(np.minimum(last[:-half], last[half:]))
        length = np.maximum(self.common[low], self.common[high])
        low, high = low.copy(), high.copy()
        for k in range(len(self._minima) - 1, -1, -1):
            table, width = self._minima[k], 1 << k
            left = low - width + 1
            go = left > 0
            go[go] = table[left[go]] >= length[go]
            low = np.where(go, low - width, low)
            go = high + width <= len(self.common) - 1
            go[go] = table[high[go]] >= length[go]
            high = np.where(go, high + width, high)
        return low, high, length.astype(np.int64)

    def matching_statistics(self, patterns: Sequence[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, position, place) wherever the longest match that starts at a position has ``least`` symbols or more.

        place: one sorted place of that match. All patterns advance together, right to left.
        """
        sizes = np.array([len(p) for p in patterns], np.int64)
        at = np.cumsum(sizes) - sizes
        whole = np.concatenate([*patterns, np.zeros(0, np.int64)]).astype(np.int64)
        alive = np.flatnonzero(sizes)
        pos, low, high = sizes - 1, np.zeros(len(sizes), np.int64), np.full(len(sizes), self.n, np.int64)
        size = np.zeros(len(sizes), np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        while len(alive):
            new_low, new_high = self.extend(whole[at[alive] + pos[alive]], low[alive], high[alive])
            fits = new_low < new_high
            hit = alive[fits]
            low[hit], high[hit] = new_low[fits], new_high[fits]
            size[hit] += 1
            long = hit[size[hit] >= least]
            found.append((long, pos[long], low[long]))
            missed = alive[~fits]
            none = missed[size[missed] == 0]
            some = missed[size[missed] > 0]
            if len(some):
                low[some], high[some], shorter = self.parent(low[some], high[some])
                size[some] = np.minimum(shorter, size[some] - 1)
            pos[hit] -= 1
            pos[none] -= 1
            alive = alive[pos[alive] >= 0]
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))

    def least_by_prefix(self, values: np.ndarray, length: int) -> np.ndarray:
        """For each sorted place, the smallest of ``values`` (one per text) among suffixes that share ``length`` symbols."""
        opens = np.flatnonzero(self.common[: self.n] < length)
        group = np.cumsum(self.common[: self.n] < length) - 1
        return np.minimum.reduceat(values[self.text_of], opens)[group] if self.n else values[:0]
