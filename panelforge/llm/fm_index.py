"""An FM-index over sequences of words: backward search on a wavelet matrix, and statistics of matches of a given length.

The text is the sequences one after another, each followed by a separator. Suffixes are sorted by their first ``length``
symbols, which backward search for patterns of up to ``length`` symbols needs; the last column of that order is kept as a
wavelet matrix of packed bits with one rank sample for each 64 bits.
"""

from __future__ import annotations

import numpy as np

END, SEPARATOR = 0, 1
NONE = np.iinfo(np.int64).max


class WaveletMatrix:
    """Ranks of symbols in a sequence, in packed bits."""

    def __init__(self, symbols: np.ndarray, levels: int):
        self.levels = []
        n = len(symbols)
        for level in range(levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            bytes_ = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed[:len(bytes_)] = bytes_
            words = packed.view(np.uint64)
            ones = np.bitwise_count(words).astype(np.int32)
            before = np.concatenate([[0], np.cumsum(ones, dtype=np.int32)[:-1]]).astype(np.int32)
            self.levels.append((level, words, before, n - int(ones.sum())))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def ranks(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences of each symbol before ``low`` and before ``high``."""
        at = np.concatenate([low, high, np.zeros(len(symbols), np.int64)])  # the third: where the symbol's run begins
        wanted = np.concatenate([symbols] * 3)
        for level, words, before, zeros in self.levels:
            w, b = at >> 6, (at & 63).astype(np.uint64)
            ones = before[w] + np.bitwise_count(words[w] & ((np.uint64(1) << b) - np.uint64(1))).astype(np.int64)
            at = np.where((wanted >> level) & 1, zeros + ones, at - ones)
        n = len(symbols)
        return at[:n] - at[2 * n:], at[n:2 * n] - at[2 * n:]


def _pairs(rank: np.ndarray, step: int) -> np.ndarray:
    """Order keys of twice-as-long prefixes: own rank, then the rank ``step`` further on."""
    n = len(rank)
    later = np.zeros(n, np.int64)
    later[:n - step] = rank[step:] + 1 if step < n else 0
    return rank * (n + 1) + later


class FMIndex:
    """Index of one shard. ``values`` has a number for each sequence; a match reports the least of its sequences."""

    def __init__(self, sequences: list[list], values: np.ndarray, length: int):
        self.length = length
        self.codes: dict = {}
        codes, sizes = self.codes, np.array([len(s) for s in sequences], np.int64)
        flat: list[int] = []
        for s in sequences:
            flat.extend(codes.setdefault(w, len(codes) + 2) for w in s)
            flat.append(SEPARATOR)
        text = np.array([*flat, END], np.int64)
        n = len(text)
        rank, step = text, 1
        while 2 * step < length:
            rank = np.unique(_pairs(rank, step), return_inverse=True)[1]
            step *= 2
        # Now ranks are by the first `step` symbols, and step < length <= 2 * step.
        key = _pairs(rank, length - step) if length > 1 else rank
        suffixes = np.argsort(key, kind="stable")
        sorted_key = key[suffixes]
        self.classes = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        shorter = (_pairs(rank, length - 1 - step) if length - 1 > step else rank)[suffixes]
        edge = np.flatnonzero(np.concatenate([[True], shorter[1:] != shorter[:-1]]))
        which = np.cumsum(np.bincount(edge, minlength=n)) - 1
        self.low, self.high = edge[which], np.concatenate([edge[1:], [n]])[which]
        owner = np.repeat(np.arange(len(sequences)), sizes + 1)
        value = np.concatenate([values[owner], [NONE]]) if len(sequences) else np.array([NONE])
        starts = np.flatnonzero(np.concatenate([[True], self.classes[1:] != self.classes[:-1]]))
        self.least = np.minimum.reduceat(value[suffixes], starts)
        last = text[suffixes - 1]
        sigma = len(codes) + 2
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.column = WaveletMatrix(last, max(1, int(sigma - 1).bit_length()))
        self.n = n

    def statistics(self, sequences: list[list]) -> list[np.ndarray]:
        """For each sequence and each window of ``length`` words, the least value of the sequences that hold it.

        All sequences are searched backward side by side. Where a match of full length stands, it is widened to all
        suffixes with one word less, so the next window costs one step; where it ends, it starts anew before the word that failed.
        """
        size = self.length
        sizes = np.array([len(s) for s in sequences], np.int64)
        base = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
        get = self.codes.get
        flat = np.array([get(w, -1) for s in sequences for w in s], np.int64)
        found = np.full(len(flat), NONE)
        live = np.flatnonzero(sizes >= size)
        at, low = sizes[live] - 1, np.zeros(len(live), np.int64)
        high, depth = np.full(len(live), self.n), np.zeros(len(live), np.int64)
        while len(live):
            c = flat[base[live] + at]
            known = np.maximum(c, 0)
            a, b = self.column.ranks(known, low, high)
            lo, hi = self.first[known] + a, self.first[known] + b
            ok = (c >= 0) & (lo < hi)
            depth = np.where(ok, depth + 1, depth)
            full = ok & (depth == size)
            where = lo[full]
            found[(base[live] + at)[full]] = self.least[self.classes[where]]
            lo[full], hi[full] = self.low[where], self.high[where]
            depth[full] -= 1
            back = np.where(ok, at - 1, np.where(depth > 0, at + depth - 1, at - 1))
            low, high = np.where(ok, lo, 0), np.where(ok, hi, self.n)
            # What is left must still reach a full window.
            depth = np.where(ok, depth, 0)
            at = back
            stay = at + depth + 1 >= size
            stay &= at >= 0
            live, at, low, high, depth = live[stay], at[stay], low[stay], high[stay], depth[stay]
        return [found[b:b + max(0, n - size + 1)] for b, n in zip(base, sizes)]
