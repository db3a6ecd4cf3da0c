"""A compressed full-text index over integer sequences, in numpy.

The Burrows-Wheeler transform of a text is held as a wavelet matrix: one bit vector
for each bit of the symbols, packed, with running counts. Backward search narrows a
range of the suffix array by one symbol at a time, here for many patterns in step.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Positions by their next ``depth`` symbols at least (prefix doubling); ties in no stated order."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    k = 1
    order = np.argsort(rank, kind="stable")
    while k < depth:
        after = np.zeros(n, np.int64)
        after[: max(0, n - k)] = rank[k:]
        key = (rank << 32) | after
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[1], key[1:] != key[:-1]]))
        k *= 2
    return order


class BitVector:
    """Packed bits with the number of ones before any position."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]]).astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Index of a text of symbols 0..sigma-1, for patterns of up to ``depth - 1`` symbols."""

    def __init__(self, text: np.ndarray, depth: int):
        self.order = suffix_array(text, depth)
        bwt = text[self.order - 1]  # the text counts as circular
        sigma = int(text.max()) + 1 if len(text) else 1
        self.levels = max(1, int(sigma - 1).bit_length())
        self.vectors: list[BitVector] = []
        self.zeros: list[int] = []
        at = bwt
        for level in reversed(range(self.levels)):
            bits = ((at >> level) & 1).astype(np.uint8)
            self.vectors.append(BitVector(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            at = np.concatenate([at[bits == 0], at[bits == 1]])
        counts = np.bincount(text, minlength=sigma)
        self.first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        self.shift = self.first - self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (vector, zeros) in enumerate(zip(self.vectors, self.zeros)):
            ones = vector.ones(at)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the patterns with one more symbol in front."""
        shift = self.shift[symbol]
        return self._descend(symbol, low) + shift, self._descend(symbol, high) + shift

    def search(self, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Suffix array ranges of text[s:s + length] for all starts s: the patterns' occurrences."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order), np.int64)
        for k in reversed(range(length)):
            low, high = self.extend(text[starts + k], low, high)
        return low, high

    def lower(self, text: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
        """Lower ends of the ranges of text[s:s + length], which the text holds: equal for equal
        patterns, different for others, and half the work of both ends."""
        low = self.first[text[starts + length - 1]]
        for k in reversed(range(length - 1)):
            symbol = text[starts + k]
            low = self._descend(symbol, low) + self.shift[symbol]
        return low
