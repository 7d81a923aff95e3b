"""A compressed FM-index over integer symbols, in numpy.

The suffixes are sorted as far as searches look; the Burrows-Wheeler
transform is kept in a wavelet tree of packed bits (one plane for each bit
of a symbol, in the layout known as wavelet matrix) with a running count
for each 64-bit word. Searches run backwards and for many patterns at once.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class BitPlane:
    """Packed bits with rank."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, dtype=np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.zeros(len(self.words), dtype=np.int32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:], dtype=np.int32)
        self.zeros = n - int(bits.sum())

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        low = (_ONE << (i & 63).astype(np.uint64)) - _ONE
        return self.before[w] + np.bitwise_count(self.words[w] & low)


class WaveletTree:
    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.planes = bits, []
        seq = symbols
        for b in reversed(range(bits)):
            one = ((seq >> b) & 1).astype(bool)
            self.planes.append(BitPlane(one))
            seq = np.concatenate([seq[~one], seq[one]])

    def rank(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """Occurrences of each symbol before ``low`` and before ``high``."""
        base = np.zeros(len(symbol), dtype=np.int64)
        for b, plane in zip(reversed(range(self.bits)), self.planes):
            one = ((symbol >> b) & 1).astype(bool)
            rb, rl, rh = plane.rank1(base), plane.rank1(low), plane.rank1(high)
            base = np.where(one, plane.zeros + rb, base - rb)
            low = np.where(one, plane.zeros + rl, low - rl)
            high = np.where(one, plane.zeros + rh, high - rh)
        return low - base, high - base


class FMIndex:
    """Index of a text of symbols >= 1; 0 separates its parts. Patterns of up
    to ``depth`` symbols can be searched."""

    def __init__(self, text: np.ndarray, depth: int):
        n = len(text)
        self.text, self.depth, self.n = text, depth, n
        rank = text.astype(np.int64)
        ranks, span = {1: rank}, 1
        order = np.argsort(rank, kind="stable")
        while span < depth + 1:
            key = rank * (int(rank.max()) + 2)
            key[:-span or None] += rank[span:] + 1
            order = np.argsort(key, kind="stable")
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            span *= 2
            ranks[span] = rank
        self.suffixes = order.astype(np.int32)
        self.shorter = self._classes(ranks, depth - 1)
        symbols = text[self.suffixes - 1]
        self.counts = np.concatenate([[0], np.cumsum(np.bincount(text))]).astype(np.int64)
        self.tree = WaveletTree(symbols, max(1, int(text.max()).bit_length()))

    def _classes(self, ranks: dict, length: int):
        """For each suffix rank, the range of ranks with the same first
        ``length`` symbols: the step up the suffix tree that drops the last
        symbol of a match of full depth."""
        if length == 0:
            return np.zeros(self.n, dtype=np.int64), np.full(self.n, self.n, dtype=np.int64)
        half = max(s for s in ranks if s <= length)
        first = ranks[half][self.suffixes]
        at = np.minimum(self.suffixes.astype(np.int64) + length - half, self.n - 1)
        second = ranks[half][at]
        new = np.ones(self.n, dtype=bool)
        new[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        end = np.append(start[1:], self.n)
        return start[group], end[group]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray):
        """The ranges after one more symbol in front; empty if not found."""
        known = (symbol > 0) & (symbol < len(self.counts) - 1)
        symbol = np.where(known, symbol, 0)
        a, b = self.tree.rank(symbol, low, high)
        base = self.counts[symbol]
        return np.where(known, base + a, 0), np.where(known, base + b, 0)

    def search(self, patterns: np.ndarray):
        """Ranges of the rows of a (count, depth) matrix of symbols."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.n, dtype=np.int64)
        for j in reversed(range(patterns.shape[1])):
            low, high = self.extend(patterns[:, j], low, high)
        return low, high

    def stream(self, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Matching statistics against the threshold for streamed pieces of
        ``symbols``: for each window of ``depth`` symbols inside a piece, in
        order, the range of its occurrences (empty: the match is shorter).

        All pieces advance together from their right ends. A window found
        gives the next one by a step up and a step to the left; after a miss
        the next window is searched anew."""
        depth = self.depth
        windows = np.maximum(lengths - depth + 1, 0)
        offset = np.concatenate([[0], np.cumsum(windows)])
        low = np.zeros(offset[-1], dtype=np.int64)
        high = np.zeros(offset[-1], dtype=np.int64)
        for step in range(int(windows.max(initial=0))):
            lanes = np.flatnonzero(windows > step)
            at = windows[lanes] - 1 - step
            begin, slot = starts[lanes] + at, offset[lanes] + at
            if step:
                hit = high[slot + 1] > low[slot + 1]
                prev = slot[hit] + 1
                rank = low[prev]
                low[slot[hit]], high[slot[hit]] = self.extend(
                    symbols[begin[hit]], self.shorter[0][rank], self.shorter[1][rank])
                begin, slot = begin[~hit], slot[~hit]
            if len(slot):
                patterns = symbols[begin[:, None] + np.arange(depth)[None, :]]
                low[slot], high[slot] = self.search(patterns)
        return low, high, offset

    def first_positions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest text position in each range of full-depth matches
        (such ranges are equal or disjoint); -1 for an empty range."""
        out = np.full(len(low), -1, dtype=np.int64)
        full = high > low
        if full.any():
            l, pick, back = np.unique(low[full], return_index=True, return_inverse=True)
            h = high[full][pick]
            edges = np.column_stack([l, h]).reshape(-1)
            if edges[-1] == self.n:
                edges = edges[:-1]
            out[full] = np.minimum.reduceat(self.suffixes, edges)[::2][back]
        return out
