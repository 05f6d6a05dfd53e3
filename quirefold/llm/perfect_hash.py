"""Minimal perfect hash over distinct 64-bit keys, built and probed with arrays.

Levels of bits: a key that lands alone on a bit of a level is placed there, the others go on to the next level. The rank
of a key's bit over all levels is its index, 0 .. n - 1. Keys that were not built in get an index of some other key or
none, so an index is used with fingerprints.
"""

from __future__ import annotations

import numpy as np

from quirefold.llm.textkit import U64, mix

GAMMA = 2.0


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    h = mix(keys + U64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return ((h >> U64(32)) * U64(size) >> U64(32)).astype(np.int64)


class PerfectHash:
    """sizes: bits of each level; words: the bits of all levels, each level padded to whole words."""

    def __init__(self, sizes: list[int], words: np.ndarray):
        self.sizes, self.words = sizes, words
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(words).astype(np.int64))))

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, words, level = [], [], 0
        while len(keys):
            size = max(64, int(GAMMA * len(keys)))
            at = _place(keys, level, size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.zeros(-(-size // 64) * 64, dtype=np.uint8)
            bits[:size] = alone
            sizes.append(size)
            words.append(np.packbits(bits, bitorder="little").view(np.uint64))
            keys, level = keys[~alone[at]], level + 1
        return cls(sizes, np.concatenate(words) if words else np.zeros(0, dtype=np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, -1 where it is sure that the key was not built in."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(left):
                break
            at = _place(keys[left], level, size)
            word = base + (at >> 6)
            bit = (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            w, b = word[hit], bit[hit]
            out[left[hit]] = self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << b) - np.uint64(1)))
            left, base = left[~hit], base + -(-size // 64)
        return out

    def dump(self) -> tuple[bytes, bytes]:
        return np.array(self.sizes, dtype=np.int64).tobytes(), self.words.tobytes()

    @classmethod
    def load(cls, sizes: bytes, words: bytes) -> PerfectHash:
        return cls(np.frombuffer(sizes, dtype=np.int64).tolist(), np.frombuffer(words, dtype=np.uint64))
