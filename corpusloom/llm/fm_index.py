"""A full-text index of word sequences: Burrows-Wheeler transform in a wavelet matrix, searched backwards."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """A sequence of numbers, one packed bit vector with counts per bit of a number."""

    def __init__(self, sequence: np.ndarray, size: int):
        self.shifts = [*range(max(1, int(size - 1).bit_length()))][::-1]
        self.bits, self.before, self.zeros = [], [], []
        for shift in self.shifts:
            bit = (sequence >> shift & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.bits.append(words)
            self.before.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)].astype(np.int32))
            self.zeros.append(len(bit) - int(bit.sum()))
            sequence = np.r_[sequence[~bit], sequence[bit]]
        # Where the occurrences of each number begin once all bits are sorted.
        every = np.arange(size)
        self.first = np.zeros(size, np.int64)
        self.first = self.down(every, np.zeros(size, np.int64))

    def down(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        for shift, bits, before, zeros in zip(self.shifts, self.bits, self.before, self.zeros):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = before[word] + np.bitwise_count(bits[word] & below)
            at = np.where(number >> shift & 1, zeros + ones, at - ones)
        return at

    def rank(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each ``number`` stands before place ``at``."""
        return self.down(number, at) - self.first[number]


class FmIndex:
    """Sequences of numbers from 1 on, laid end to end with a separator (0) after each.

    Suffixes end at their separator, and separators are ordered by place. ``rows``
    gives the sequence of each suffix in sorted order.
    """

    def __init__(self, tokens: np.ndarray, size: int, longest: int, width: int):
        """``tokens`` with a 0 after each sequence; ``size`` is above every number, ``longest`` the most numbers
        of a sequence; searches are for ``width`` numbers."""
        n = len(tokens)
        stops = tokens == 0
        m = int(stops.sum())
        rank = np.where(stops, np.cumsum(stops) - 1, tokens.astype(np.int64) + m - 1)
        span, at_width = 1, None
        while True:
            if at_width is None and 2 * span >= width:
                # Equal ranks of two overlapping halves: equal in their first ``width`` numbers.
                at_width = span, rank
            if span > longest:
                break
            pair = rank << 32
            pair[: n - span] |= rank[span:] + 1
            order = np.argsort(pair, kind="stable")
            new = np.r_[False, pair[order[1:]] != pair[order[:-1]]]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            span *= 2
        order = np.argsort(rank)
        self.width = width
        self.rows = (np.cumsum(stops) - stops)[order]
        self.matrix = WaveletMatrix(tokens[order - 1], size)
        self.smaller = np.r_[0, np.cumsum(np.bincount(tokens, minlength=size))]
        # Neighbours in sorted order that differ in their first ``width`` numbers bound the widest matches.
        span, rank = at_width
        half = np.r_[rank, np.full(width, -1)]
        second = half[order + width - span]
        differ = np.r_[True, (half[order[1:]] != half[order[:-1]]) | (second[1:] != second[:-1])]
        starts = np.flatnonzero(differ)
        self.group = np.cumsum(differ) - 1
        self.bounds = np.r_[starts, n]

    def extend(self, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows of all suffixes that begin with ``number`` before what rows ``low`` to ``high`` begin with."""
        first = self.smaller[number]
        return first + self.matrix.rank(number, low), first + self.matrix.rank(number, high)

    def longest(self, tokens: np.ndarray, at: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows from, to and length of the longest match of up to ``most`` numbers that begins at each place."""
        n = len(at)
        low, high, length = np.zeros(n, np.int64), np.full(n, len(self.group), np.int64), np.zeros(n, np.int64)
        open_ = np.flatnonzero((most > 0) & (tokens[at] > 0))
        most = most.copy()
        while len(open_):
            lo, hi = np.zeros(len(open_), np.int64), np.full(len(open_), len(self.group), np.int64)
            for step in range(int(most[open_].max())):
                part = np.flatnonzero((most[open_] > step) & (lo < hi))
                number = tokens[at[open_[part]] + most[open_[part]] - 1 - step]
                lo[part], hi[part] = self.extend(number, lo[part], hi[part])
            done = open_[lo < hi]
            low[done], high[done], length[done] = lo[lo < hi], hi[lo < hi], most[done]
            most[open_] -= 1
            open_ = open_[(lo >= hi) & (most[open_] > 0)]
        return low, high, length

    def windows(self, tokens: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of sequences, cut at ``width``: all places that match ``width`` numbers, with their rows.

        Sequence k is the ``sizes[k]`` numbers before ``tokens[ends[k]]``. All are read backwards in
        step: a number is put in front, and a match that grows over ``width`` is widened to the rows that
        share its first ``width`` numbers. Where the longer match is not in the index, its end is cut until
        it is. Number 0 matches nothing. Returned are places in ``tokens`` and the rows from, to.
        """
        low = np.zeros(len(ends), np.int64)
        high = np.full(len(ends), len(self.group), np.int64)
        length = np.zeros(len(ends), np.int64)
        found = []
        live = np.flatnonzero(sizes > 0)
        step = 0
        while len(live):
            step += 1
            at = ends[live] - step
            number = tokens[at]
            lo, hi = self.extend(number, low[live], high[live])
            lost = (lo >= hi) | (number == 0)
            length[live] += 1
            if lost.any():
                lo[lost], hi[lost], length[live[lost]] = self.longest(tokens, at[lost], length[live[lost]] - 1)
            over = length[live] > self.width
            if over.any():
                group = self.group[lo[over]]
                lo[over], hi[over] = self.bounds[group], self.bounds[group + 1]
                length[live[over]] = self.width
            low[live], high[live] = lo, hi
            whole = length[live] == self.width
            found.append((at[whole], lo[whole], hi[whole]))
            live = live[sizes[live] > step]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
