"""A compressed full-text index over word symbols: context-sorted BWT in a wavelet matrix, with backward search."""

from __future__ import annotations

import numpy as np


class _Bits:
    """A bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words), dtype=np.int64)].astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits before each position."""
        block = at >> 6
        low = self.words[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[block] + np.bitwise_count(low)


class FMIndex:
    """Backward search for patterns of at most ``depth`` words in ``text`` (symbols >= 1; 0 separates passages).

    Suffixes are sorted by their first ``depth`` symbols, which is all that patterns of that length need.  The BWT is
    kept in a wavelet matrix: log2(symbols) bits for each word.  ``starts[d]`` are the places where a new group of
    suffixes with the same first d symbols begins.
    """

    def __init__(self, text: np.ndarray, depth: int):
        if not len(text) or text[-1]:
            text = np.r_[text, 0].astype(np.int64)
        n = len(text)
        self.n, self.depth = n, depth
        rank, known = text.astype(np.int64), 1
        while known < depth:
            step = min(known, depth - known)
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1 if step < n else after[: n - step]
            rank = np.unique(rank * (int(rank.max(initial=0)) + 2) + after, return_inverse=True)[1]
            known += step
        self.order = np.argsort(rank, kind="stable")
        same = np.zeros(n, np.uint8)
        alive = np.arange(1, n)
        for d in range(depth):
            a, b = self.order[alive - 1] + d, self.order[alive] + d
            inside = (a < n) & (b < n)
            alive, a, b = alive[inside], a[inside], b[inside]
            alive = alive[text[a] == text[b]]
            same[alive] = d + 1
        self.starts = [np.r_[np.flatnonzero(same < d), n].astype(np.int32) for d in range(depth + 1)]
        self.starts[0] = np.array([0, n], np.int32)
        self.symbols = int(text.max(initial=0)) + 1
        self.first = np.r_[0, np.cumsum(np.bincount(text, minlength=self.symbols))].astype(np.int64)
        self.levels: list[tuple[int, _Bits, int]] = []
        bwt = text[self.order - 1].astype(np.int32)
        for level in reversed(range(max(1, (self.symbols - 1).bit_length()))):
            bit = (bwt >> level & 1).astype(np.uint8)
            self.levels.append((level, _Bits(bit), int(n - bit.sum())))
            bwt = np.concatenate([bwt[bit == 0], bwt[bit == 1]])
        every = np.arange(self.symbols)
        self.offset = self.first[:-1] - self._descend(every, np.zeros(self.symbols, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, bits, zeros in self.levels:
            ones = bits.rank(at)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One backward step: the intervals of symbol + pattern from those of the pattern."""
        k = len(lo)
        at = self._descend(np.r_[symbol, symbol], np.r_[lo, hi]) + np.r_[self.offset[symbol], self.offset[symbol]]
        return at[:k], at[k:]

    def shorten(self, length: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Drop pattern ends: widen each interval to that of the pattern's first ``length`` symbols."""
        lo, hi = lo.copy(), hi.copy()
        for d in np.unique(length).tolist():
            at = np.flatnonzero(length == d)
            begin = self.starts[d]
            lo[at] = begin[np.searchsorted(begin, lo[at], "right") - 1]
            hi[at] = begin[np.searchsorted(begin, hi[at], "left")]
        return lo, hi

    def matching_statistics(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray):
        """Stream texts flat[begin:begin+size] through the index, all of them together, last word first.

        Yields, for each distance from the texts' ends, (texts, positions, length, lo, hi): the longest match (at most
        ``depth`` words) that starts at that position and the interval of its occurrences.  Symbols that the index
        lacks are given as 0 and match nothing.
        """
        lane = np.argsort(-size, kind="stable")
        lo, hi = np.zeros(len(lane), np.int64), np.full(len(lane), self.n, np.int64)
        length = np.zeros(len(lane), np.int64)
        for back in range(1, int(size.max(initial=0)) + 1):
            k = int(np.searchsorted(-size[lane], -back, "right"))
            lane, lo, hi, length = lane[:k], lo[:k], hi[:k], length[:k]
            at = begin[lane] + size[lane] - back
            symbol = flat[at]
            full = np.flatnonzero(length == self.depth)
            if len(full):
                length[full] -= 1
                lo[full], hi[full] = self.shorten(length[full], lo[full], hi[full])
            todo = np.arange(k)
            while len(todo):
                a, b = self.extend(symbol[todo], lo[todo], hi[todo])
                hit = (b > a) & (symbol[todo] > 0)
                done = todo[hit]
                lo[done], hi[done] = a[hit], b[hit]
                length[done] += 1
                todo = todo[~hit]
                over = todo[length[todo] == 0]
                lo[over], hi[over] = 0, self.n
                todo = todo[length[todo] > 0]
                length[todo] -= 1
                lo[todo], hi[todo] = self.shorten(length[todo], lo[todo], hi[todo])
            yield lane, at - begin[lane], length, lo, hi
