"""FM-index over word symbols: suffix order, Burrows-Wheeler transform in a wavelet matrix,
backward search, and locating by sampled suffix positions. Many patterns are searched at once.
"""

from __future__ import annotations

import numpy as np


class RankBits:
    """Bits with the number of ones before any place: one running count per 64-bit word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])[:-1]
        self.ones = int(counts.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels, row = [], symbols.astype(np.uint32)
        for level in range(self.depth - 1, -1, -1):
            bits = (row & np.uint32(1 << level)).astype(bool)
            ranks = RankBits(bits)
            self.levels.append((level, ranks, len(row) - ranks.ones))
            if level:
                row = np.concatenate([np.compress(~bits, row), np.compress(bits, row)])

    def rank(self, symbol: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place; ``start`` is :meth:`origin` of them."""
        for level, ranks, zeros in self.levels:
            ones = ranks.rank(at)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at - start

    def origin(self, symbol: np.ndarray) -> np.ndarray:
        return self.rank(symbol, np.zeros(len(symbol), np.int64), np.int64(0))

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at the places, and where they end up at the lowest level."""
        symbol = np.zeros(len(at), np.int64)
        for level, ranks, zeros in self.levels:
            bit, ones = ranks.get(at), ranks.rank(at)
            symbol |= bit.astype(np.int64) << level
            at = np.where(bit, zeros + ones, at - ones)
        return symbol, at


def suffix_order(first_ranks: np.ndarray, by_first: np.ndarray) -> np.ndarray:
    """Suffix array by doubling; only suffixes that still tie are sorted again.

    ``first_ranks`` holds for each place the slot of its symbol's first suffix when sorted by
    symbol, ``by_first`` the places in that order. Every text must end in a symbol of its own, so
    that all suffixes differ in the end.
    """
    n = len(first_ranks)
    rank, order, step = first_ranks.copy(), by_first.copy(), 1
    slots = np.arange(n)
    while True:
        own = rank[order[slots]]
        new = np.concatenate([[True], own[1:] != own[:-1]])
        single = new & np.concatenate([new[1:], [True]])
        slots = slots[~single]
        if not len(slots):
            return order
        places = order[slots]
        group = rank[places]
        after = rank[np.minimum(places + step, n - 1)]
        if n < 1 << 21:  # three numbers in one word sort as one
            key = (group << 42 | after << 21 | np.arange(len(slots))).astype(np.int64)
            key.sort()
            moved = key & ((1 << 21) - 1)
        else:
            moved = np.lexsort((after, group))
        places, group, after = places[moved], group[moved], after[moved]
        order[slots] = places
        starts = np.concatenate([[True], (group[1:] != group[:-1]) | (after[1:] != after[:-1])])
        rank[places] = slots[np.maximum.accumulate(np.where(starts, np.arange(len(slots)), 0))]
        step *= 2


class FMIndex:
    """Index of a row of texts given as word hashes; ``first[i]`` is where text i begins."""

    SAMPLE = 16

    def __init__(self, hashes: np.ndarray, first: np.ndarray):
        n_texts = len(first) - 1
        n = len(hashes) + n_texts
        owner = np.repeat(np.arange(n_texts), np.diff(first))
        places = np.arange(len(hashes)) + owner  # one end symbol after each text
        ends = first[1:] + np.arange(n_texts)
        by_hash = _argsort(hashes)
        sorted_hashes = hashes[by_hash]
        new = np.concatenate([[True], sorted_hashes[1:] != sorted_hashes[:-1]]) if len(hashes) else np.zeros(0, bool)
        self.vocabulary = sorted_hashes[new]
        starts = np.flatnonzero(new)
        first_slot = starts[np.cumsum(new) - 1] if len(hashes) else starts
        ranks = np.empty(n, np.int64)
        ranks[ends] = np.arange(n_texts)
        ranks[places[by_hash]] = first_slot + n_texts
        by_first = np.concatenate([ends, places[by_hash]])
        self.order_start = np.concatenate([[0], starts + n_texts])  # symbol 0: all ends
        symbols = np.zeros(n, np.int64)
        symbols[places[by_hash]] = np.cumsum(new)
        order = suffix_order(ranks, by_first)
        self.n, self.places = n, places
        before = np.where(order == 0, n - 1, order - 1)
        self.bwt = WaveletMatrix(symbols[before], len(self.vocabulary) + 1)
        self.origins = self.bwt.origin(np.arange(len(self.vocabulary) + 1))
        # Ends of texts are unique symbols sorted by place, so a step back over an end is not the
        # step of the shared symbol 0; places that follow an end are always sampled instead.
        begins = first[:-1] + np.arange(n_texts)
        sampled = (order % self.SAMPLE == 0) | np.isin(order, begins)
        self.sampled, self.samples = RankBits(sampled), order[sampled]

    def find(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pattern, low, high) of the patterns that occur: their range of suffixes.

        ``patterns`` is a matrix of word hashes, row i right-aligned in its last lengths[i] columns.
        """
        symbol = np.searchsorted(self.vocabulary, patterns)
        known = symbol < len(self.vocabulary)
        known[known] = self.vocabulary[symbol[known]] == patterns[known]
        width = patterns.shape[1]
        used = np.arange(width) >= width - lengths[:, None]
        live = np.flatnonzero((known | ~used).all(axis=1) & (lengths > 0))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.n, np.int64)
        for column in range(width - 1, -1, -1):
            act = np.flatnonzero(used[live, column])
            if not len(act):
                break
            c = symbol[live[act], column] + 1
            base, origin = self.order_start[c], self.origins[c]
            low[act] = base + self.bwt.rank(c, low[act], origin)
            high[act] = base + self.bwt.rank(c, high[act], origin)
            keep = low < high
            live, low, high = live[keep], low[keep], high[keep]
        return live, low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(range, place) of every suffix in the ranges, places counted with end symbols."""
        sizes = high - low
        which = np.repeat(np.arange(len(low)), sizes)
        at = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(int(sizes.sum()))
        out, steps = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        open_ = np.arange(len(at))
        while len(open_):
            here = at[open_]
            done = self.sampled.get(here)
            out[open_[done]] = self.samples[self.sampled.rank(here[done])] + steps[open_[done]]
            open_ = open_[~done]
            if len(open_):
                symbol, lowest = self.bwt.access(at[open_])
                at[open_] = self.order_start[symbol] + lowest - self.origins[symbol]
                steps[open_] += 1
        return which, out


def _argsort(values: np.ndarray) -> np.ndarray:
    """Order that brings equal 64-bit values together in ascending order."""
    n = len(values)
    if n >= 1 << 21:
        return np.argsort(values, kind="stable")
    packed = (values & ~np.uint64((1 << 21) - 1)) | np.arange(n, dtype=np.uint64)
    packed.sort()
    order = (packed & np.uint64((1 << 21) - 1)).astype(np.int64)
    ordered = values[order]
    return order if (ordered[1:] >= ordered[:-1]).all() else np.argsort(values, kind="stable")
