"""Minimal perfect hashing of 64-bit keys.

Level by level, every key marks a bit of a vector twice as long as there are keys; keys that are
alone on their bit are placed, the others go to the next level. A key's index is the number of
marked bits before its own over all levels, so n keys get 0 to n - 1 with about four bits a key
(and a directory of counts that is rebuilt when the bits are read).
The keys themselves, kept by index, verify that a key that is looked up is one of them.
"""

from __future__ import annotations

import numpy as np

from plumbline.llm.common import MIX, mixed

SPREAD = 2
BLOCK = 512


def hashed(keys: np.ndarray, level: int) -> np.ndarray:
    return mixed(keys.view(np.uint64) * MIX + np.uint64(level * 0x51ED270B + 1))


class PerfectHash:
    def __init__(self, levels: list[np.ndarray], keys: np.ndarray | None):
        self.levels = levels  # marked bits, packed into 64-bit words, a multiple of eight of them
        self.keys = keys
        words = np.concatenate(levels) if levels else np.empty(0, np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.words = words
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in levels])]).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        """For distinct keys."""
        levels, left = [], keys
        while len(left):
            if len(levels) > 200:
                raise ValueError("the keys are not distinct")
            n = -(-SPREAD * len(left) // BLOCK) * BLOCK
            at = (hashed(left, len(levels)) % np.uint64(n)).astype(np.int64)
            alone = np.bincount(at, minlength=n) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        out = cls(levels, None)
        at = out.index(keys)
        out.keys = np.empty(len(keys), np.int64)
        out.keys[at] = keys
        return out

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Places of keys; -1 for one that is not among them (unverified before ``keys`` are set)."""
        out = np.full(len(keys), -1, np.int64)
        left, place = keys, np.arange(len(keys))
        for level, words in enumerate(self.levels):
            if not len(left):
                break
            at = (hashed(left, level) % np.uint64(64 * len(words))).astype(np.int64)
            here = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            found = at[here] + 64 * self.first[level]
            out[place[here]] = self.rank(found)
            left, place = left[~here], place[~here]
        if self.keys is not None and len(self.keys):
            out[(out >= 0) & (self.keys[out] != keys)] = -1
        return out

    def rank(self, bit: np.ndarray) -> np.ndarray:
        """Marked bits before a place."""
        word = bit >> 6
        below = (np.uint64(1) << (bit & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & below)

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.keys), len(self.levels), *map(len, self.levels)], "<i8")
        return b"".join(x.tobytes() for x in (sizes, self.words.astype("<u8"), self.keys.astype("<i8")))

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n, levels = (int(x) for x in np.frombuffer(raw, "<i8", 2))
        sizes = np.frombuffer(raw, "<i8", levels, 16)
        at, found = 16 + 8 * levels, []
        for size in sizes:
            found.append(np.frombuffer(raw, "<u8", int(size), at))
            at += 8 * int(size)
        return cls(found, np.frombuffer(raw, "<i8", n, at))
