"""An FM-index over integer symbols in numpy: backward search through wavelet-matrix ranks."""

from __future__ import annotations

import numpy as np

from .suffix_array import refine


class Wavelet:
    """Ranks of symbols in a sequence; every query takes arrays."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            ones = np.zeros(len(seq) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(seq) - int(ones[-1]))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        at, base = upto, np.zeros_like(upto)
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            one = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            at = np.where(one, zeros + ones[at], at - ones[at])
            base = np.where(one, zeros + ones[base], base - ones[base])
        return at - base


class FMIndex:
    """text: symbols from 1 to n_symbols - 1; 0 is the end. Every `sample`-th position is stored."""

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = 8):
        text = np.append(text, 0).astype(np.int64)
        sa, _ = refine(text, 1)
        self.bwt = text[sa - 1]
        self.wavelet = Wavelet(self.bwt, n_symbols)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=n_symbols))))
        self.marked = sa % sample == 0
        self.marks = np.cumsum(self.marked) - 1
        self.stored = sa[self.marked]
        self.size = len(text)

    def find(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges [low, high) of the suffixes that start with each pattern (a row, padded)."""
        low, high = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.size, np.int64)
        for step in range(int(lengths.max(initial=0))):
            go = np.flatnonzero((lengths > step) & (low < high))
            symbol = patterns[go, lengths[go] - 1 - step]
            low[go] = self.first[symbol] + self.wavelet.rank(symbol, low[go])
            high[go] = self.first[symbol] + self.wavelet.rank(symbol, high[go])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back through the text up to a stored position."""
        out, todo, rows, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(todo):
            hit = self.marked[rows]
            out[todo[hit]] = self.stored[self.marks[rows[hit]]] + steps
            todo, rows = todo[~hit], rows[~hit]
            symbol = self.bwt[rows]
            rows = self.first[symbol] + self.wavelet.rank(symbol, rows)
            steps += 1
        return out
