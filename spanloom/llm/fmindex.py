"""An FM-index over a sequence of words, in numpy: suffix array by prefix doubling, wavelet matrix
over the Burrows-Wheeler transform, backward search of many patterns at once, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(first: np.ndarray) -> np.ndarray:
    """Of a sequence of non-negative symbols; the end counts as smaller than any symbol."""
    n = len(first)
    _, rank = np.unique(first, return_inverse=True)
    rank, step = rank.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while True:
        sorted_rank = rank[order]
        tied = np.zeros(n, bool)
        same = sorted_rank[1:] == sorted_rank[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        at = np.nonzero(tied)[0]  # places in the order that aren't settled; the others stay
        if not len(at):
            return order
        who = order[at]
        after = np.where(who + step < n, rank[np.minimum(who + step, n - 1)] + 1, 0)
        by = np.lexsort((after, rank[who]))
        who, after = who[by], after[by]
        order[at] = who
        group = rank[who]
        new = np.empty(len(who), bool)
        new[0] = True
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        head = np.maximum.accumulate(np.where(new, at, 0))  # a group's rank: its first place
        settled = np.nonzero(~tied)[0]
        rank[order[settled]] = settled
        rank[who] = head
        step *= 2


class Bits:
    """A bit vector with ranks: words of 64 bits and counts before each."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        packed = np.concatenate([packed, np.zeros(-len(packed) % 8 + 8, np.uint8)])
        self.words = packed.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def ones(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    def __init__(self, symbols: np.ndarray, top: int):
        self.levels, current = [], symbols
        for bit in range(max(1, int(top).bit_length()) - 1, -1, -1):
            one = (current >> bit) & 1 == 1
            self.levels.append((bit, Bits(one), int((~one).sum())))
            current = np.concatenate([current[~one], current[one]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often symbol stands before i, for each pair."""
        start = np.zeros_like(i)
        for bit, bits, zeros in self.levels:
            one = (symbol >> bit) & 1 == 1
            a, b = bits.ones(start), bits.ones(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return i - start

    def symbol_and_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        start, symbol = np.zeros_like(i), np.zeros_like(i)
        for bit, bits, zeros in self.levels:
            one = bits.get(i) == 1
            symbol |= one.astype(np.int64) << bit
            a, b = bits.ones(start), bits.ones(i)
            start, i = np.where(one, zeros + a, start - a), np.where(one, zeros + b, i - b)
        return symbol, i - start


class FMIndex:
    """symbols: 1 and up for words, 0 for breaks, which no pattern has and each of which is unlike the
    others; the last symbol is a break. Every ``sample``th place and each first place after a break keeps its position."""

    def __init__(self, symbols: np.ndarray, sample: int = 16):
        n, breaks = len(symbols), symbols == 0
        unlike = np.where(breaks, np.cumsum(breaks) - 1, symbols + int(breaks.sum()))
        order = suffix_array(unlike)
        top = int(symbols.max(initial=1))
        self.n = n
        self.wavelet = Wavelet(symbols[order - 1].astype(np.int64), top)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=top + 1))])
        kept = (np.arange(n) % sample == 0) | np.concatenate([[True], breaks[:-1]])
        self.kept = Bits(kept[order])
        self.positions = order[kept[order]]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns: one a row. The rows of the suffix array, [low, high), that begin with each."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.nonzero((patterns < len(self.below) - 1).all(1))[0]
        high[:] = np.where(np.isin(np.arange(len(patterns)), live), high, 0)
        for j in range(patterns.shape[1] - 1, -1, -1):
            if not len(live):
                break
            c = patterns[live, j].astype(np.int64)
            both = self.wavelet.rank(np.concatenate([c, c]), np.concatenate([low[live], high[live]]))
            low[live], high[live] = self.below[c] + both[: len(c)], self.below[c] + both[len(c) :]
            live = live[low[live] < high[live]]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of rows of the suffix array: back by last-to-first steps to a kept place."""
        found, todo, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.astype(np.int64), 0
        while len(todo):
            here = self.kept.get(at) == 1
            found[todo[here]] = self.positions[self.kept.ones(at[here])] + steps
            todo, at = todo[~here], at[~here]
            if len(todo):
                c, before = self.wavelet.symbol_and_rank(at)
                at, steps = self.below[c] + before, steps + 1
        return found
