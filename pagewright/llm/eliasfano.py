"""Elias-Fano sequences and the n-gram trie level built of them, in one flat image that can be memory-mapped."""

from __future__ import annotations

import mmap
import struct

import numpy as np

#: Log10 probabilities are stored in 16 bits, rounded down, over this span; code 0 stands for none.
SPAN = 16.0
LEVELS = (1 << 16) - 1


def quantise(log10p: np.ndarray) -> np.ndarray:
    return np.clip(np.floor((log10p + SPAN) * (LEVELS / SPAN)), 1, LEVELS).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) * (SPAN / LEVELS) - SPAN


class EliasFano:
    """A non-decreasing sequence of integers below ``universe``; arrays: low bits, high bits, ones before each 64."""

    def __init__(self, n: int, universe: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.universe, self.low, self.high, self.before = n, universe, low, high, before
        self.width = self.low_width(n, universe)
        self.zeros_before = 64 * np.arange(len(before), dtype=np.int64) - before.astype(np.int64)

    @staticmethod
    def low_width(n: int, universe: int) -> int:
        return max(0, (max(universe, 1) // max(n, 1)).bit_length() - 1)

    @classmethod
    def build(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = values.astype(np.uint64)
        n, width = len(values), cls.low_width(len(values), universe)
        low = np.zeros(n * width // 64 + 2, np.uint64)
        if width:
            part, at = values & np.uint64((1 << width) - 1), np.arange(n, dtype=np.int64) * width
            shift = (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, at >> 6, part << shift)
            over = (at & 63) + width > 64
            np.bitwise_or.at(low, (at[over] >> 6) + 1, part[over] >> (np.uint64(64) - shift[over]))
        top = int(universe >> width) + 2
        bits = np.zeros((n + top) // 64 * 64 + 64, np.uint8)
        bits[(values >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
        high = np.packbits(bits, bitorder="little").view(np.uint64)
        before = np.concatenate([[0], np.cumsum(np.bitwise_count(high), dtype=np.int64)[:-1]]).astype(np.uint32)
        return cls(n, universe, low, high, before)

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high, self.before]

    def _zero(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th zero (from 0) of the high bits."""
        word = np.searchsorted(self.zeros_before, k, "right") - 1
        left, bits, at = k - self.zeros_before[word], ~self.high[word], np.zeros(len(k), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            mask = np.uint64((1 << step) - 1)
            count = np.bitwise_count((bits >> at.astype(np.uint64)) & mask).astype(np.int64)
            go = left >= count
            left, at = left - np.where(go, count, 0), at + np.where(go, step, 0)
        return word * 64 + at

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th values (from 0)."""
        word = np.searchsorted(self.before, i, "right") - 1
        left, bits, at = i - self.before[word].astype(np.int64), self.high[word], np.zeros(len(i), np.int64)
        for step in (32, 16, 8, 4, 2, 1):
            mask = np.uint64((1 << step) - 1)
            count = np.bitwise_count((bits >> at.astype(np.uint64)) & mask).astype(np.int64)
            go = left >= count
            left, at = left - np.where(go, count, 0), at + np.where(go, step, 0)
        return (word * 64 + at - i << self.width) + self.lows(i).astype(np.int64)

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> shift
        over = (at & 63) + self.width > 64
        out[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return out & np.uint64((1 << self.width) - 1)

    def find(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(place of the first value >= x, whether it equals x), by successor search in x's bucket of high bits, from ``first`` to before ``last``."""
        x = x.astype(np.int64)
        high = x >> self.width
        start = np.where(high > 0, self._zero(np.maximum(high - 1, 0)) - (high - 1), 0)
        stop = self._zero(high) - high
        if first is not None:
            start, stop = np.maximum(start, first), np.minimum(stop, last)
        want = (x & ((1 << self.width) - 1)).astype(np.uint64)
        lo, hi = start.copy(), stop.copy()
        while (open_ := lo < hi).any():
            mid = (lo + hi) >> 1
            less = np.zeros(len(x), bool)
            less[open_] = self.lows(mid[open_]) < want[open_]
            lo, hi = np.where(open_ & less, mid + 1, lo), np.where(open_ & ~less, mid, hi)
        same = lo < stop
        same[same] = self.lows(lo[same]) == want[same]
        return lo, same


class NgramLevel:
    """One trie level: contexts, pointers to their children, children as context-relative ids, probability codes.

    A child is stored as (rank of its context) * universe + word, which makes the whole level one monotone
    sequence; looking up a word below a context is a successor search from the context's own base. A context
    is the place of a node in the level above, and carries the code of its back-off weight.
    """

    MAGIC = b"EFT2"

    def __init__(self, contexts: EliasFano, pointers: EliasFano, children: EliasFano, codes: np.ndarray, weights: np.ndarray, universe: int):
        self.contexts, self.pointers, self.children, self.codes, self.weights, self.universe = contexts, pointers, children, codes, weights, universe

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, log10p: np.ndarray, log10w: np.ndarray | None = None) -> NgramLevel:
        """From n-grams sorted by (context, word), without repeats; ``log10w``: by distinct context."""
        own, first = np.unique(context, return_index=True)
        universe = int(word.max()) + 1 if len(word) else 1
        rank = np.repeat(np.arange(len(own)), np.diff(np.append(first, len(context))))
        return cls(
            EliasFano.build(own, int(own.max()) + 1 if len(own) else 1), EliasFano.build(np.append(first, len(context)), len(context) + 1),
            EliasFano.build(rank * universe + word, max(1, len(own)) * universe), quantise(log10p), np.zeros(0, np.uint16) if log10w is None else quantise(log10w), universe,
        )

    def span(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the children of the rank-th contexts begin and end, by the pointers."""
        return self.pointers.get(rank), self.pointers.get(rank + 1)

    def ranks(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, rank) of contexts; rank is 0 where the level lacks one."""
        known, rank = np.zeros(len(context), bool), np.zeros(len(context), np.int64)
        ask = (context >= 0) & (context < self.contexts.universe) & (self.contexts.n > 0)
        if ask.any():
            rank[ask], known[ask] = self.contexts.find(context[ask])
        rank[~known] = 0
        return known, rank

    def followers(self, context: np.ndarray) -> np.ndarray:
        """How many children each context has; 0 for one that the level lacks."""
        known, rank = self.ranks(context)
        out = np.zeros(len(context), np.int64)
        if known.any():
            first, last = self.span(rank[known])
            out[known] = last - first
        return out

    def lookup(self, context: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, place, code) of each n-gram; place and code are 0 where it is not found."""
        found, place, code, _ = self.below(context, np.arange(len(context)), word)
        return found, place, code

    def below(self, context: np.ndarray, owner: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(found, place, code) of each word below the context that owns it, and the weight code of each context (0: none).

        Each context is sought, and its span read through the pointers, once.
        """
        found, place = np.zeros(len(word), bool), np.zeros(len(word), np.int64)
        known, rank = self.ranks(context)
        weight = np.where(known, self.weights[rank], 0) if len(self.weights) else np.zeros(len(context), np.uint16)
        ask = known[owner] & (word >= 0) & (word < self.universe)
        if ask.any():
            first, last = self.span(rank)
            own = owner[ask]
            at, same = self.children.find(rank[own] * self.universe + word[ask], first[own], last[own])
            found[ask], place[ask] = same, at
        place[~found] = 0
        return found, place, np.where(found, self.codes[place] if len(self.codes) else 0, 0), weight

    def image(self) -> bytes:
        parts = [a for ef in (self.contexts, self.pointers, self.children) for a in ef.arrays()] + [self.codes, self.weights]
        sizes = [v for ef in (self.contexts, self.pointers, self.children) for v in (ef.n, ef.universe)] + [self.universe]
        head = self.MAGIC + struct.pack("<4x7Q11Q", *sizes, *[len(p) for p in parts])
        return head + b"".join(p.tobytes() + b"\0" * (-p.nbytes % 8) for p in parts)

    @classmethod
    def map(cls, image) -> NgramLevel:
        """Over any buffer that holds an image; nothing is copied."""
        if bytes(image[:4]) != cls.MAGIC:
            raise ValueError("not an n-gram level")
        values = struct.unpack_from("<7Q11Q", image, 8)
        at, arrays = 8 + 8 * 18, []
        for k, n in enumerate(values[7:]):
            kind = np.uint16 if k > 8 else (np.uint64, np.uint64, np.uint32)[k % 3]
            arrays.append(np.frombuffer(image, kind, n, at))
            at += arrays[-1].nbytes + -arrays[-1].nbytes % 8
        fano = [EliasFano(values[2 * k], values[2 * k + 1], *arrays[3 * k : 3 * k + 3]) for k in range(3)]
        return cls(*fano, arrays[9], arrays[10], values[6])

    @classmethod
    def mapped(cls, image: bytes) -> NgramLevel:
        """In an anonymous memory map of its own."""
        space = mmap.mmap(-1, len(image))
        space.write(image)
        return cls.map(space)

    @classmethod
    def open(cls, path: str) -> NgramLevel:
        """From a file written with ``image()``, paged in as it is read."""
        return cls.map(memoryview(np.memmap(path, np.uint8, "r")))


class NgramTrie:
    """The levels of a trie, words first: all words are children of the one context 0 of the first level."""

    MAGIC = b"EFTR"

    def __init__(self, levels: list[NgramLevel]):
        self.levels = levels

    def walk(self, nodes: list[np.ndarray], owners: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Descend together along a query trie: (codes by level, back-off weights by level but the last).

        nodes: the words of the query's nodes by level; owners: for the levels below the first, the place of
        each node's parent in the level above.
        """
        codes, weights, context = [], [], np.zeros(1, np.int64)
        for k, (level, words) in enumerate(zip(self.levels, nodes)):
            found, place, code, weight = level.below(context, owners[k - 1] if k else np.zeros(len(words), np.int64), words)
            codes.append(code)
            if k:
                weights.append(weight)
            context = np.where(found, place, -1)
        return codes, weights

    def image(self) -> bytes:
        parts = [level.image() for level in self.levels]
        return self.MAGIC + struct.pack(f"<I{len(parts)}Q", len(parts), *map(len, parts)) + b"".join(parts)

    @classmethod
    def map(cls, image) -> NgramTrie:
        if bytes(image[:4]) != cls.MAGIC:
            raise ValueError("not an n-gram trie")
        count = struct.unpack_from("<I", image, 4)[0]
        at, levels = 8 + 8 * count, []
        for size in struct.unpack_from(f"<{count}Q", image, 8):
            levels.append(NgramLevel.map(image[at : at + size]))
            at += size
        return cls(levels)

    @classmethod
    def open(cls, path: str) -> NgramTrie:
        """From a file written with ``image()``, paged in as it is read."""
        return cls.map(memoryview(np.memmap(path, np.uint8, "r")))
