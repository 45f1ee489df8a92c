"""Canonical, length-limited Huffman codes of ids, packed and unpacked many at a time."""

from __future__ import annotations

import numpy as np

MAX_BITS = 20
STEP = 128  # ids between checkpoints


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Best code lengths of at most ``most`` bits (more only if there are over 2**most symbols),
    by merging packages level by level; symbols with count zero get length zero."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    most = max(most, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(most):
        both = np.concatenate([weights, packages])
        place = np.argsort(both, kind="stable")
        levels.append(place < n)
        both = both[place]
        packages = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, times = 2 * n - 2, np.zeros(n, np.int64)
    for symbol in reversed(levels):
        own = int(symbol[:take].sum())
        times[:own] += 1
        take = 2 * (take - own)
    lengths[order] = times
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint64)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    code, before = 0, 0
    sizes, starts = np.unique(lengths[order], return_index=True)
    for size, a, b in zip(sizes.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
        code <<= size - before
        codes[order[a:b]] = np.arange(code, code + b - a, dtype=np.uint64)
        code, before = code + b - a, size
    return codes


class Coder:
    def __init__(self, lengths: np.ndarray):
        self.lengths, self.codes = lengths.astype(np.uint64), canonical(lengths)
        self.most = int(lengths.max(initial=1))
        # Decoding table: any word of `most` bits starts with one code. Codes ascend with length,
        # so the table is the symbols in canonical order, each as often as its free bits allow.
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        times = np.int64(1) << (self.most - lengths[order])
        self.symbol = np.zeros(1 << self.most, np.uint32)
        self.size = np.ones(1 << self.most, np.uint8)
        full = int(times.sum())
        self.symbol[:full], self.size[:full] = np.repeat(order, times), np.repeat(lengths[order], times)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Packed bits, and the bit offset of every STEP-th id."""
        return self.encode_all(ids, np.array([len(ids)]))[0]

    def encode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[tuple[bytes, np.ndarray]]:
        """As :meth:`encode` for texts one after another with so many ids each; every text
        starts at a whole byte of its own."""
        if not len(ids):
            return [(b"", np.zeros(0, np.int64))] * len(counts)
        sizes, codes = self.lengths[ids], self.codes[ids]
        running = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        into = np.concatenate([[0], np.cumsum(counts)])
        bits = np.diff(running[into])
        ends = np.cumsum(-(-bits // 8))
        begins = ends - -(-bits // 8)
        inside = running[:-1] - np.repeat(running[into[:-1]], counts)
        at = (inside + np.repeat(8 * begins, counts)).astype(np.uint64)
        word, bit = at >> np.uint64(5), at & np.uint64(31)
        shifted = codes << (np.uint64(64) - sizes - bit)
        new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        out = np.zeros(int(ends[-1]) // 4 + 3, np.uint64)
        out[word[new]] += np.add.reduceat(shifted >> np.uint64(32), new)
        out[word[new] + np.uint64(1)] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), new)
        data = out.astype(">u4").tobytes()
        return [(data[a:b], inside[i:j:STEP]) for a, b, i, j in zip(begins.tolist(), ends.tolist(), into[:-1].tolist(), into[1:].tolist())]

    def decode(self, data: bytes, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of lanes that start at the given bits and hold so many ids each, one lane after
        another; all lanes advance together through the table."""
        padded = np.frombuffer(data + b"\0" * 8, np.uint8)
        # 32 bits from every byte on; codes longer than 24 bits do not fit such a window
        window = padded[:-3].astype(np.uint32) << np.uint32(24)
        for i, shift in ((1, 16), (2, 8), (3, 0)):
            window |= padded[i : len(padded) - 3 + i].astype(np.uint32) << np.uint32(shift)
        into = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(int(into[-1]), np.uint32)
        order = np.argsort(-counts, kind="stable")
        at, place, left = starts[order].astype(np.int64), into[:-1][order], counts[order]
        for step in range(int(left[0]) if len(left) else 0):
            live = int(np.searchsorted(-left, -step, "left"))  # lanes with more ids than steps done
            here = at[:live]
            look = (window[here >> 3] << (here & 7).astype(np.uint32)) >> np.uint32(32 - self.most)
            out[place[:live] + step] = self.symbol[look]
            at[:live] += self.size[look]
        return out
