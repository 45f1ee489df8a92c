"""Word hashes of many texts at once, on byte arrays.

The hash of a word is a polynomial over random byte values, taken from running sums, so that
no loop over words is needed; hashes of word sequences are made the same way. All arithmetic is
modulo 2**64.
"""

from __future__ import annotations

import numpy as np

_BASE, _SEQUENCE, _SECOND = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93  # odd, so that powers have inverses
_VALUES = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}
SLICE = 1 << 17  # values hashed at once

SPACES = b" \t\n\x0b\x0c\r"


def _kept(keep, lower: bool) -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for byte in range(256):
        low = byte + 32 if lower and 65 <= byte <= 90 else byte
        if keep(low):
            table[byte] = low
    table[0] = 1 if keep(0) else 0  # zero marks separators
    return table


#: Byte tables: what a byte counts as inside a word, 0 for separators.
BETWEEN_SPACES = _kept(lambda b: b not in SPACES, lower=False)
ALPHANUMERIC = _kept(lambda b: b >= 128 or 48 <= b <= 57 or 97 <= b <= 122, lower=True)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words in which every input bit sways every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 2 * SLICE), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if len(have) == 2 * SLICE:  # those of a span longer than a slice do not stay in memory
            _POWERS[base] = have
    return have[:n]


def _spans(values: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray, wide: np.ndarray | None = None) -> np.ndarray:
    """Polynomial hash of values[start:end] for every span, independent of its place.

    Starts ascend. Running sums are made for one slice of starts at a time, so that the memory
    beside the result is that of a slice and its longest span. ``wide`` turns small values into
    those that are hashed.
    """
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    cuts = np.searchsorted(starts, np.arange(starts[0], starts[-1] + 1, SLICE))
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(starts)]):
        if a == b:
            continue
        low, high = int(starts[a]), int(ends[a:b].max())
        part = values[low:high] if wide is None else wide[values[low:high]]
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum(part * _powers(base, high - low), out=sums[1:])
        first, last = starts[a:b] - low, ends[a:b] - low
        inverse = _powers(pow(base, -1, 2**64), max(high - low, int(first[-1]) + 1))
        out[a:b] = mix((sums[last] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
    return out


class Words:
    """Words of a list of texts: hashes in order, byte places, and the text each belongs to."""

    def __init__(self, texts: list[bytes], table: np.ndarray, seed: int = 0):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kept = table[self.data]
        kept[self.offsets[1:] - 1] = 0
        inside = np.zeros(len(kept) + 2, bool)
        np.not_equal(kept, 0, out=inside[1:-1])
        self.starts = np.flatnonzero(inside[1:] & ~inside[:-1])
        self.ends = np.flatnonzero(inside[:-1] & ~inside[1:])
        base = _BASE + 2 * seed
        self.hashes = _spans(kept, base, self.starts, self.ends, _VALUES)
        # first[i] is the number of words before text i
        self.first = np.searchsorted(self.starts, self.offsets)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, hash) of every run of n words inside one text; start counts over all words."""
        starts = inside_starts(self.first, n)
        return starts, sequence_hashes(self.hashes, starts, starts + n)


def inside_starts(first: np.ndarray, n: int) -> np.ndarray:
    """Starts of the runs of n items that do not cross from one text into the next."""
    total = int(first[-1])
    ok = np.ones(total + 1, bool)
    ok[total] = False
    for back in range(1, n):  # the last n - 1 items of each text start no run
        places = first[1:] - back
        ok[places[places >= first[:-1]]] = False
    return np.flatnonzero(ok)


def second_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Other hashes of the same sequences: words that agree in the first ones need not agree here."""
    return _spans(mix(hashes ^ np.uint64(_BASE)), _SECOND, starts, ends)


def sequence_hashes(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return _spans(hashes, _SEQUENCE, starts, ends)
