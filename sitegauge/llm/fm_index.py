"""FM-index of a shard of words: suffix array, wavelet matrix, backward search and sampled positions."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with rank: packed 64-bit words and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(8 + (-len(packed)) % 8, dtype=np.uint8)])
        self.words = packed.view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)[:-1]])
        self.ones = int(ones.sum())

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def rank(self, end: np.ndarray) -> np.ndarray:
        """Ones before each place of ``end``."""
        word = end >> 6
        mask = (np.uint64(1) << (end & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)


class WaveletMatrix:
    """Symbols of ``bits`` bits, most significant bit first; at each level zeros go before ones."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.size = bits, len(symbols)
        self.levels: list[Bits] = []
        self.zeros: list[int] = []
        for level in reversed(range(bits)):
            b = (symbols >> level) & 1
            self.levels.append(Bits(b.astype(np.uint8)))
            self.zeros.append(len(symbols) - self.levels[-1].ones)
            symbols = np.concatenate([symbols[b == 0], symbols[b == 1]])

    def rank(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each ``end``."""
        start = np.zeros_like(end)
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = bits.rank(start), bits.rank(end)
            start = np.where(one, zeros + a, start - a)
            end = np.where(one, zeros + b, end - b)
        return end - start

    def get(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.int64)
        for bits, zeros in zip(self.levels, self.zeros):
            one, r = bits.get(at).astype(bool), bits.rank(at)
            out = out << 1 | one
            at = np.where(one, zeros + r, at - r)
        return out


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes; zeros are separators, each smaller than any symbol and ordered by place.

    Prefix doubling; only suffixes that still tie with another are sorted again.
    """
    n = len(symbols)
    rank = symbols.astype(np.int64) + n
    ends = np.flatnonzero(symbols == 0)
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    value = rank[order]
    new = np.ones(n, dtype=bool)
    new[1:] = value[1:] != value[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # first place of the group of equals
    rank[order] = group
    step = 1
    while True:
        tied = ~new
        tied[:-1] |= ~new[1:]
        places = np.flatnonzero(tied)
        if not len(places):
            return order
        some = order[places]
        first, second = rank[some], rank[some + step]  # a tie holds no separator yet, so step stays inside
        again = np.lexsort((second, first))
        some, first, second = some[again], first[again], second[again]
        order[places] = some
        fresh = np.ones(len(places), dtype=bool)
        fresh[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new[places] = fresh
        head = np.maximum.accumulate(np.where(fresh, places, 0))
        rank[some] = head
        step *= 2


class FMIndex:
    """Search and locate patterns over symbols 1 to ``alphabet`` with zeros as separators.

    The sequence must end with a zero. Every ``sample``-th place and every first place after a separator
    keeps its suffix position; the others are found by stepping back.
    """

    def __init__(self, symbols: np.ndarray, alphabet: int, sample: int = 8):
        order = suffix_array(symbols)
        before = symbols[order - 1]  # of place 0: the last, a separator
        self.size = len(symbols)
        self.tree = WaveletMatrix(before.astype(np.int64), max(1, int(alphabet).bit_length()))
        counts = np.bincount(symbols, minlength=alphabet + 2)
        self.smaller = np.concatenate([[0], np.cumsum(counts)])
        kept = (order % sample == 0) | (before == 0)
        self.kept, self.positions = Bits(kept.astype(np.uint8)), order[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of suffixes that begin with each row of ``patterns``, from the last symbol to the first."""
        low = np.zeros(len(patterns), dtype=np.int64)
        high = np.full(len(patterns), self.size, dtype=np.int64)
        live = np.arange(len(patterns))
        for column in reversed(range(patterns.shape[1])):
            symbol = patterns[live, column].astype(np.int64)
            low[live] = self.smaller[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.smaller[symbol] + self.tree.rank(symbol, high[live])
            live = live[high[live] > low[live]]
            if not len(live):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes of ``rows``: steps back to a kept position are counted."""
        out = np.zeros(len(rows), dtype=np.int64)
        open_, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            found = self.kept.get(at).astype(bool)
            out[open_[found]] = self.positions[self.kept.rank(at[found])] + steps
            open_, at = open_[~found], at[~found]
            if len(open_):
                symbol = self.tree.get(at)
                at = self.smaller[symbol] + self.tree.rank(symbol, at)
                steps += 1
        return out
