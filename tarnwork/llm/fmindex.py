"""A compressed FM-index of word sequences in numpy: wavelet matrix, backward search, matching statistics.

The index serves patterns of at most ``depth`` words.  Suffixes are sorted by
their first ``depth`` words only, which leaves every interval of such a pattern
exact and takes a fixed number of sorts.  The last column is kept as a wavelet
matrix: one bit vector for each bit of the alphabet, with counts every 64 bits.

All queries move in step: an operation works on the intervals of all of them.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros(-(-(n + 1) // 64) * 8, np.uint8)
        raw = np.packbits(bits, bitorder="little")
        packed[: len(raw)] = raw
        self.words = packed.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1])).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.rows: list[Bits] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bits = (symbols >> level & 1).astype(bool)
            self.rows.append(Bits(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            symbols = np.concatenate((symbols[~bits], symbols[bits]))
        # Where each symbol's run begins on the last level.
        starts = np.zeros(alphabet, np.int64)
        if len(symbols):
            change = np.flatnonzero(np.concatenate(([True], symbols[1:] != symbols[:-1])))
            starts[symbols[change]] = change
        self.starts = starts

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        for k, row in enumerate(self.rows):
            one = (symbol >> (self.levels - 1 - k) & 1).astype(bool)
            ones = row.rank(at)
            at = np.where(one, self.zeros[k] + ones, at - ones)
        return at - self.starts[symbol]


def _ranks(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks; equal pairs have one rank."""
    key = first.astype(np.int64) * (int(second.max(initial=0)) + 1) + second
    order = np.argsort(key, kind="stable")
    step = np.concatenate(([0], np.cumsum(key[order][1:] != key[order][:-1]))) if len(key) else np.empty(0, np.int64)
    out = np.empty(len(key), np.int64)
    out[order] = step
    return out


def _shifted(ranks: np.ndarray, by: int) -> np.ndarray:
    """Ranks of the suffixes ``by`` places on, one higher; 0 behind the end."""
    out = np.zeros(len(ranks), np.int64)
    out[: max(0, len(ranks) - by)] = ranks[by:] + 1
    return out


def prefix_ranks(text: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix by its first ``length`` symbols, by doubling."""
    have, ranks = 1, _ranks(text, np.zeros(len(text), np.int64))
    while have * 2 <= length:
        ranks = _ranks(ranks, _shifted(ranks, have))
        have *= 2
    if have < length:
        # The last ``have`` symbols of the prefix overlap the first ones, which changes no order.
        ranks = _ranks(ranks, _shifted(ranks, length - have))
    return ranks


class FMIndex:
    """Index of a text over symbols from 1 on; 0 separates sequences and is part of no pattern."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.depth = depth
        alphabet = int(text.max(initial=0)) + 1
        ranks = prefix_ranks(text, depth)
        self.suffixes = np.argsort(ranks, kind="stable")
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=alphabet))))
        last = text[self.suffixes - 1]  # the text is a circle; what stands before the first symbol is the last separator
        self.matrix = WaveletMatrix(last, alphabet)
        shorter = prefix_ranks(text, depth - 1)[self.suffixes]
        edge = np.ones(n + 1, bool)
        edge[1:n] = shorter[1:] != shorter[:-1]
        places = np.arange(n + 1)
        # Ends of the interval of all suffixes that agree on depth - 1 symbols (the parent interval).
        self.down = np.maximum.accumulate(np.where(edge, places, 0))
        self.up = np.minimum.accumulate(np.where(edge, places, n)[::-1])[::-1]
        own = ranks[self.suffixes]
        self.group = np.concatenate(([0], np.cumsum(own[1:] != own[:-1]))) if n else np.empty(0, np.int64)
        self.heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if n else np.empty(0, np.int64)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front (backward search)."""
        both = self.matrix.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        start = self.smaller[symbol]
        return start + both[: len(symbol)], start + both[len(symbol) :]

    def shorten(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From patterns of ``depth`` symbols to their first ``depth - 1``."""
        return self.down[low], self.up[high]

    def least(self, values: np.ndarray) -> np.ndarray:
        """For each group of suffixes that agree on ``depth`` symbols, the least value at their places."""
        return np.minimum.reduceat(values[self.suffixes], self.heads) if len(self.heads) else values

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, lengths: np.ndarray):
        """Streams sequences (by the place behind their end) backwards through the index, all in step.

        Yields (sequence, place, low, high) for the places from which ``depth``
        symbols match, with their interval.  A match that has grown to ``depth``
        symbols is shortened by its last one before the next goes in front.
        """
        order = np.argsort(-lengths, kind="stable")
        ends, lengths = ends[order], lengths[order]
        low = np.zeros(len(order), np.int64)
        high = np.full(len(order), len(self.suffixes), np.int64)
        matched = np.zeros(len(order), np.int64)
        for step in range(1, int(lengths.max(initial=0)) + 1):
            live = int(np.searchsorted(-lengths, -step, "right"))
            low, high, matched = low[:live], high[:live], matched[:live]
            place = ends[:live] - step
            full = matched == self.depth
            if full.any():
                low, high = low.copy(), high.copy()
                low[full], high[full] = self.shorten(low[full], high[full])
                matched = np.where(full, self.depth - 1, matched)
            low, high = self.extend(text[place], low, high)
            lost = high <= low  # not for sequences that are in the index; else the search starts anew
            low, high = np.where(lost, 0, low), np.where(lost, len(self.suffixes), high)
            matched = np.where(lost, 0, matched + 1)
            done = np.flatnonzero(matched == self.depth)
            if len(done):
                yield order[done], place[done], low[done], high[done]
