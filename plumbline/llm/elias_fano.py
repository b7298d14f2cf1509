"""Elias-Fano codes of rising sequences.

``n`` numbers up to ``u`` are split at ``log2(u / n)`` bits: the low bits lie side by side, the
high ones are the positions of ones in a bit vector of at most ``3 n`` bits. A directory of 32-bit
counts, one per block of 512 bits, lets ``select`` find the i-th number without reading the
others. Together they take about ``2.4 + log2(u / n)`` bits a number.
"""

from __future__ import annotations

import numpy as np

BLOCK_WORDS = 8
WORD = np.uint64(64)


def packed_bits(values: np.ndarray, width: int) -> np.ndarray:
    """The lowest ``width`` bits of all numbers side by side, as 64-bit words with one to spare."""
    words = np.zeros((len(values) * width + 63) // 64 + 1, np.uint64)
    if width and len(values):
        at = np.arange(len(values), dtype=np.uint64) * np.uint64(width)
        low = values & np.uint64((1 << width) - 1)
        word, shift = at // WORD, at % WORD
        np.bitwise_or.at(words, word, low << shift)
        over = shift + np.uint64(width) > WORD
        np.bitwise_or.at(words, word[over] + np.uint64(1), low[over] >> (WORD - shift[over]))
    return words


def bits_at(words: np.ndarray, i: np.ndarray, width: int) -> np.ndarray:
    """The numbers at places ``i`` of ``packed_bits``."""
    if not width:
        return np.zeros(len(i), np.uint64)
    at = i.astype(np.uint64) * np.uint64(width)
    word, shift = at // WORD, at % WORD
    high = np.where(shift > 0, words[word + np.uint64(1)] << ((WORD - shift) % WORD), np.uint64(0))
    return ((words[word] >> shift) | high) & np.uint64((1 << width) - 1)


class EliasFano:
    """A rising sequence of numbers from 0 to 2^64 - 1, equal neighbours allowed."""

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray):
        self.n, self.width, self.low, self.high = n, width, low, high
        ones = np.bitwise_count(high).reshape(-1, BLOCK_WORDS).sum(axis=1)
        self.before = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if n and (values[1:] < values[:-1]).any():
            raise ValueError("the numbers must not fall")
        if n >= 1 << 30:
            raise ValueError("more than 2^30 numbers: cut the sequence")
        most = int(values[-1]) if n else 0
        width = max((most // max(n, 1)).bit_length() - 1, 0)
        tops = (values >> np.uint64(width)) + np.arange(n, dtype=np.uint64)
        blocks = (int(tops[-1]) if n else 0) // (64 * BLOCK_WORDS) + 1
        high = np.zeros(blocks * BLOCK_WORDS, np.uint64)
        np.bitwise_or.at(high, tops // WORD, np.uint64(1) << (tops % WORD))
        return cls(n, width, packed_bits(values, width), high)

    def select(self, i) -> np.ndarray:
        """The numbers at places ``i``: a search in the directory, then one block each."""
        i = np.atleast_1d(np.asarray(i, np.int64))
        if len(i) and (i.min() < 0 or i.max() >= self.n):
            raise IndexError("no such place")
        block = np.searchsorted(self.before, i, side="right") - 1
        rest = i - self.before[block].astype(np.int64)
        words = self.high.reshape(-1, BLOCK_WORDS)[block]
        bits = np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(i), 64), axis=1, bitorder="little")
        found = (np.cumsum(bits, axis=1, dtype=np.int16) == (rest + 1)[:, None]).argmax(axis=1)
        top = (block * 64 * BLOCK_WORDS + found - i).astype(np.uint64)
        return (top << np.uint64(self.width)) | bits_at(self.low, i, self.width)

    def slice(self, start: int, stop: int) -> np.ndarray:
        """The numbers from one place up to another, a thousand at a time."""
        parts = [self.select(np.arange(i, min(i + 1024, stop))) for i in range(start, stop, 1024)]
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)

    def bits(self) -> int:
        """Bits taken, the directory included."""
        return 64 * (len(self.low) + len(self.high)) + 32 * len(self.before)

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.width, len(self.low), len(self.high)], "<u8")
        return b"".join(x.astype("<u8").tobytes() for x in (head, self.low, self.high))

    @classmethod
    def from_bytes(cls, raw: bytes) -> EliasFano:
        n, width, low, high = (int(x) for x in np.frombuffer(raw, "<u8", 4))
        words = np.frombuffer(raw, "<u8", low + high, 32)
        return cls(n, width, words[:low], words[low:])
