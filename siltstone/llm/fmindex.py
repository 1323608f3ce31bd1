"""A compressed FM-index over words: suffix order to a bounded depth, a wavelet matrix of the transform, backward search.

The index serves patterns of at most ``depth`` words. Suffixes are ordered by their first 64 (or more) words, which is all
that backward search to that depth looks at. The wavelet matrix keeps one bit per word and level plus a 32-bit count per
64 bits, a fifth of a byte per word and level. Which suffixes agree on ``depth`` words is kept as one bit a suffix with the
same counts. Beside these the index holds the words of its patterns (4 bytes each) and a number per group of equal
suffixes; the arrays that build it are gone once it stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Bits:
    """Bits with ranks: ones(i) is how many are set before place i."""

    def __init__(self, bits: np.ndarray) -> None:
        self.packed = np.packbits(np.r_[bits.astype(np.uint8), np.zeros(64 - len(bits) % 64, np.uint8)], bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.packed))].astype(np.uint32)[:-1]

    def ones(self, i: np.ndarray) -> np.ndarray:
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block].astype(np.int64) + np.bitwise_count(self.packed[block] & mask)


class WaveletMatrix:
    """rank(c, i): how often c stands before place i, for many (c, i) at once."""

    def __init__(self, values: np.ndarray, sigma: int) -> None:
        self.n, self.levels = len(values), max(1, int(sigma - 1).bit_length())
        self.bits, self.zeros = [], []
        now = values.astype(np.uint32)
        for level in range(self.levels - 1, -1, -1):
            one = ((now >> np.uint32(level)) & np.uint32(1)).astype(bool)
            self.bits.append(Bits(one))
            self.zeros.append(self.n - int(one.sum()))
            now = np.concatenate([now[~one], now[one]])
        self.start = self._descend(np.arange(sigma), np.zeros(sigma, np.int64))

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            ones = self.bits[k].ones(i)
            bit = (c >> (self.levels - 1 - k)) & 1
            i = np.where(bit == 1, self.zeros[k] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._descend(c, i) - self.start[c]


class FMIndex:
    """Over segments of word hashes; ``owner`` is a number per segment, and searches report the least owner of an interval."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, owner: np.ndarray, depth: int = 50) -> None:
        alphabet, ids = np.unique(words, return_inverse=True)
        self.depth, self.sigma, m = depth, len(alphabet) + 1, len(lengths)
        n = len(words) + m
        ends = np.cumsum(lengths + 1)
        text = np.zeros(n, np.int64)  # a 0 closes each segment
        place = np.arange(len(words)) + np.repeat(np.arange(m), lengths)
        text[place] = ids + 1
        self.text, self.first, self.lengths = text.astype(np.uint32), ends - lengths - 1, lengths
        rank, done, half, near = text, 1, 1, text
        while done < depth + 1:
            if done <= depth:
                half, near = done, rank
            rank = self._double(rank, done)
            done *= 2
        order = np.argsort(rank, kind="stable")
        del rank
        # suffixes that agree on their first `depth` words are neighbours; runs of them are the intervals of full windows
        key = near * (n + 1)
        key[: n - (depth - half)] += near[depth - half :]
        key = key[order]
        fresh = np.r_[True, key[1:] != key[:-1]]
        del key, near
        self.run_start = np.flatnonzero(fresh)
        self.run_end = np.r_[self.run_start[1:], n]
        self.runs = Bits(fresh)
        segment = np.repeat(np.arange(m), lengths + 1)
        self.run_least = np.minimum.reduceat(owner[segment][order], self.run_start)
        self.bwt = WaveletMatrix(text[order - 1], self.sigma)
        self.less = np.r_[0, np.cumsum(np.bincount(text, minlength=self.sigma))][:-1]

    @staticmethod
    def _double(rank: np.ndarray, h: int) -> np.ndarray:
        n = len(rank)
        key = rank * (n + 1)
        key[: n - h] += rank[h:] + 1
        order = np.argsort(key)
        got = key[order]
        out = np.empty(n, np.int64)
        out[order] = np.cumsum(np.r_[0, got[1:] != got[:-1]])
        return out

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Stream every segment through backward search, last word first: (segment, start, least owner) of its full windows.

        The matching statistic of a place grows by one word a step; once it passes ``depth`` the interval widens to the run of
        suffixes that agree on ``depth`` words, so each step is one extension for all segments at once.
        """
        by_length = np.argsort(-self.lengths, kind="stable")
        lo, hi = np.zeros(len(by_length), np.int64), np.full(len(by_length), len(self.text), np.int64)
        for t in range(1, int(self.lengths.max(initial=0)) + 1):
            live = int(np.searchsorted(-self.lengths[by_length], -t, "right"))
            seg = by_length[:live]
            c = self.text[self.first[seg] + self.lengths[seg] - t].astype(np.int64)
            both = self.less[np.r_[c, c]] + self.bwt.rank(np.r_[c, c], np.r_[lo[:live], hi[:live]])
            lo[:live], hi[:live] = both[:live], both[live:]
            if t >= self.depth:
                run = self.runs.ones(lo[:live] + 1) - 1
                if t > self.depth:
                    lo[:live], hi[:live] = self.run_start[run], self.run_end[run]
                yield seg, self.lengths[seg] - t, self.run_least[run]
