"""Minimal perfect hash of 64-bit keys, in levels of bit arrays.

Each level deals the keys that are left into twice as many slots; keys alone in their slot stay,
the others go on. A key's index is the number of set bits before its slot, over all levels.
"""

from __future__ import annotations

import numpy as np

from thoughtlog.llm.words import mix

_SLOTS_A_KEY = 2


def _slots(keys: np.ndarray, level: int, n: int) -> np.ndarray:
    return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) % np.uint64(n)).astype(np.int64)


def build(keys: np.ndarray) -> list[bytes]:
    """Bit arrays of the levels for distinct keys; the first four bytes are the slot count."""
    levels, level = [], 0
    while len(keys):
        n = _SLOTS_A_KEY * len(keys)
        slots = _slots(keys, level, n)
        alone = np.bincount(slots, minlength=n) == 1
        levels.append(n.to_bytes(4, "little") + np.packbits(alone).tobytes())
        keys, level = keys[~alone[slots]], level + 1
    return levels


class PerfectHash:
    def __init__(self, levels: list[bytes]):
        self.bits, self.before, placed = [], [], 0
        for level in levels:
            n = int.from_bytes(level[:4], "little")
            bits = np.unpackbits(np.frombuffer(level, np.uint8, offset=4), count=n).astype(bool)
            ranks = np.cumsum(bits) + (placed - 1)
            placed = int(ranks[-1]) + 1
            self.bits.append(bits)
            self.before.append(ranks)
        self.size = placed

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of every key; of a key that was not in the build, any index or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.bits, self.before)):
            slots = _slots(keys[left], level, len(bits))
            hit = bits[slots]
            out[left[hit]] = ranks[slots[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out
