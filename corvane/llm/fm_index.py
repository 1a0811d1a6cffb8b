"""A word-level FM-index in numpy: suffix order, wavelet ranks, backward search, sampled positions.

Symbol 0 ends a run: it stands for the end of a text and for any word that no
phrase holds.  Suffixes are ordered up to the first 0, ties by position, which
is the order that distinct terminators would give; so backward steps by a
symbol other than 0 are exact for phrases of any length, whatever the copies.
"""

from __future__ import annotations

import numpy as np

from corvane.llm.kernel import runs


def _order(first: np.ndarray, second: np.ndarray, position: np.ndarray, bits: int) -> np.ndarray:
    """Indexes that sort by (first, second, position)."""
    if 3 * bits <= 62:
        at = np.sort((first << (2 * bits)) | (second << bits) | position) & ((1 << bits) - 1)
        index = np.empty(int(position.max()) + 1, dtype=np.int64)
        index[position] = np.arange(len(position))
        return index[at]
    return np.lexsort((position, second, first))


def suffix_array(symbols: np.ndarray, symbol_bits: int) -> np.ndarray:
    """Positions in suffix order; ``symbols`` (int64) ends with 0."""
    n = len(symbols)
    ends, p = np.flatnonzero(symbols == 0), np.flatnonzero(symbols)
    n_ends = len(ends)
    if not len(p):
        return ends
    bits = max(1, int(n).bit_length())
    k = max(1, (62 - bits) // symbol_bits)
    padded = np.concatenate((symbols, np.zeros(k, dtype=np.int64)))
    key, alive = symbols[p], np.ones(len(p), dtype=bool)
    for j in range(1, k):
        following = padded[p + j]
        following[~alive] = 0
        alive &= following > 0
        key = (key << symbol_bits) | following
    if k * symbol_bits + bits <= 62:
        packed = np.sort((key << bits) | p)
        sa, key = packed & ((1 << bits) - 1), packed >> bits
    else:
        by = np.lexsort((p, key))
        sa, key = p[by], key[by]
    ended = (key & ((1 << symbol_bits) - 1)) == 0
    fresh = np.concatenate(([True], key[1:] != key[:-1])) | ended
    at = np.arange(len(sa))
    group = np.maximum.accumulate(np.where(fresh, at, 0))
    rank = np.empty(n, dtype=np.int64)
    rank[ends] = np.arange(n_ends)
    rank[sa] = n_ends + group
    # Only groups of equal prefixes remain; each round doubles the compared length.
    follows = np.append(~fresh[1:], False)
    open_at, h = np.flatnonzero(~fresh | follows), k
    while len(open_at):
        position, first = sa[open_at], group[open_at]
        second = rank[position + h]
        by = _order(first, second, position, bits + 1)
        position, first, second = position[by], first[by], second[by]
        sa[open_at] = position
        differs = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        start = np.maximum.accumulate(np.where(differs, open_at, 0))
        group[open_at] = start
        rank[position] = n_ends + start
        open_at = open_at[~differs | np.append(~differs[1:], False)]
        h *= 2
    return np.concatenate((ends, sa))


class FMIndex:
    """Counts and locates phrases of symbols 1..n_symbols."""

    #: Every position divisible by this is sampled, and every start of a run.
    STEP = 16

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.n_symbols, self.bits = n_symbols, max(1, int(n_symbols).bit_length())
        sa = suffix_array(symbols, self.bits)
        bwt = symbols[sa - 1]
        live = bwt != 0
        self.live = np.concatenate(([0], np.cumsum(live, dtype=np.int32)))
        counts = np.bincount(symbols, minlength=n_symbols + 1)
        self.below = np.concatenate(([0], np.cumsum(counts)))  # below[c]: symbols smaller than c
        # Wavelet matrix of what precedes, without the 0s.
        sequence, self.levels = bwt[live], []
        for bit in range(self.bits - 1, -1, -1):
            ones = ((sequence >> bit) & 1).astype(bool)
            rank = np.concatenate(([0], np.cumsum(ones, dtype=np.int32)))
            self.levels.append((bit, rank, len(sequence) - int(rank[-1])))
            sequence = np.concatenate((sequence[~ones], sequence[ones]))
        every = np.arange(n_symbols + 1)
        self.origin = self._descend(every, np.zeros(n_symbols + 1, dtype=np.int64))
        sampled = ~live | (sa % self.STEP == 0)
        self.sampled = sampled
        self.sample_rank = np.cumsum(sampled, dtype=np.int32) - 1
        self.samples = sa[sampled]

    def _descend(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for bit, rank, zeros in self.levels:
            ones = rank[i]
            i = np.where((symbol >> bit) & 1, zeros + ones, i - ones)
        return i

    def rank(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """How often the symbol precedes the rows before ``row``."""
        return self._descend(symbol, self.live[row].astype(np.int64)) - self.origin[symbol]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """phrases: [m, length]. Returns the phrases that occur and their row ranges."""
        which = np.arange(len(phrases))
        last = phrases[:, -1]
        low, high = self.below[last], self.below[last + 1]
        for j in range(phrases.shape[1] - 2, -1, -1):
            some = low < high
            which, low, high = which[some], low[some], high[some]
            symbol = phrases[which, j]
            low = self.below[symbol] + self.rank(symbol, low)
            high = self.below[symbol] + self.rank(symbol, high)
        some = low < high
        return which[some], low[some], high[some]

    def _back(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one symbol earlier; that symbol isn't 0."""
        i = self.live[row].astype(np.int64)
        symbol = np.zeros(len(row), dtype=np.int64)
        for bit, rank, zeros in self.levels:
            before = rank[i]
            one = rank[i + 1] > before
            symbol |= one.astype(np.int64) << bit
            i = np.where(one, zeros + before, i - before)
        return self.below[symbol] + i - self.origin[symbol]

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the range, position) of each row in the ranges."""
        size = high - low
        which = np.repeat(np.arange(len(low)), size)
        row = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        position = np.zeros(len(row), dtype=np.int64)
        todo, steps = np.arange(len(row)), 0
        while len(todo):
            done = self.sampled[row]
            position[todo[done]] = self.samples[self.sample_rank[row[done]]] + steps
            todo, row = todo[~done], row[~done]
            row, steps = self._back(row), steps + 1
        return which, position


def merge(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """A mask of n positions that any of the spans covers."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, start, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def mask_spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    start, size = runs(mask)
    keep = mask[start] if len(mask) else np.zeros(0, dtype=bool)
    return start[keep], start[keep] + size[keep]
