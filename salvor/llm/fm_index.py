"""A compressed FM-index over word numbers, searched for many patterns at once."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence, one packed bit row per bit of a symbol."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        self.bits = max(1, int(symbols - 1).bit_length())
        for bit in reversed(range(self.bits)):
            ones = ((sequence >> bit) & 1).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view(np.uint64)
            before = np.zeros(len(packed), np.int32)
            np.cumsum(np.bitwise_count(packed[:-1]), out=before[1:])
            self.levels.append((packed, before, int((~ones).sum())))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])
        self.first = self._down(np.arange(symbols), np.zeros(symbols, np.int64))

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for depth, (packed, before, zeros) in enumerate(self.levels):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(packed[word] & mask)
            at = np.where((symbol >> (self.bits - 1 - depth)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._down(symbol, at) - self.first[symbol]


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes, ordered by at least their first ``depth`` symbols."""
    rank, step = np.unique(text, return_inverse=True)[1].astype(np.int64) + 1, 1
    while step < depth and int(rank.max()) < len(text):
        rest = np.zeros(len(text), np.int64)
        rest[:-step] = rank[step:]
        rank = np.unique(rank * (len(text) + 1) + rest, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2
    return np.argsort(rank, kind="stable")


class FMIndex:
    """Counts patterns of at most ``depth`` - 1 symbols in a text of 0..n-1.

    Suffixes that agree in ``depth`` symbols keep any order: an interval of a
    pattern shorter than that is the same either way.
    """

    def __init__(self, text: np.ndarray, symbols: int, depth: int):
        order = suffix_order(text, depth)
        self.tree = WaveletMatrix(text[order - 1], symbols)
        self.begin = np.zeros(symbols + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=symbols), out=self.begin[1:])

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, longest: int, least: int = 2) -> np.ndarray:
        """For each end the length of the longest match that ends there.

        A match is a run of symbols that occurs ``least`` times or more in the
        indexed text; lengths stop at ``longest``. All ends are extended to the
        left together, those without a match leave.
        """
        length = np.zeros(len(ends), np.int64)
        symbol = text[ends]
        low, high, lane = self.begin[symbol], self.begin[symbol + 1], np.arange(len(ends))
        for step in range(1, longest + 1):
            alive = high - low >= least
            low, high, lane = low[alive], high[alive], lane[alive]
            length[lane] = step
            if step == longest or not len(lane):
                break
            symbol = text[ends[lane] - step]
            both = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
            low, high = self.begin[symbol] + both[: len(lane)], self.begin[symbol] + both[len(lane) :]
        return length
