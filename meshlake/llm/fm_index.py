"""An FM-index over the words of a shard: suffix array, Burrows-Wheeler transform in a wavelet matrix, sampled positions.

A shard's documents are one sequence of symbols: the words' ranks in the shard's
sorted vocabulary of hashes, from 1, and a 0 after each document. Zeros are
ordered by their position, so that no suffix compares beyond its document.
"""

from __future__ import annotations

import numpy as np

from .blocks import packed, unpacked

#: Every such position is sampled, and every document's first.
SAMPLED = 8


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by prefix doubling. Only suffixes that still equal a neighbour are sorted again; zeros differ by their position."""
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    first = symbols.astype(np.int64) + len(ends)
    first[ends] = np.arange(len(ends))
    bits = max(1, int(len(ends) + symbols.max(initial=0)).bit_length())
    wide = max(1, min(4, 63 // bits))
    key = np.zeros(n, np.int64)
    for k in range(wide):
        key <<= bits
        key[: n - k] |= first[k:]
    order = np.argsort(key, kind="stable")
    new = np.append(True, key[order[1:]] != key[order[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    depth = wide
    # Slots of the order whose suffix has an equal neighbour so far; they are filled anew by every round.
    slots = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(slots):
        at = order[slots]
        # An equal pair lies within its document, so that no position runs over the end.
        key = rank[at] * n + rank[np.minimum(at + depth, n - 1)]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[slots] = at
        new = np.append(True, key[1:] != key[:-1])
        rank[at] = np.maximum.accumulate(np.where(new, slots, 0))
        slots = slots[~(new & np.append(new[1:], True))]
        depth *= 2
    return order


class Bits:
    """A bit vector with ranks."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.append(0, np.cumsum(np.bitwise_count(words), dtype=np.int64))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Set bits in front of each place."""
        word = at >> 6
        rest = self.words[np.minimum(word, len(self.words) - 1)] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.where(word < len(self.words), np.bitwise_count(rest), 0)


def bit_words(bits: np.ndarray) -> np.ndarray:
    out = np.zeros(max(1, -(-len(bits) // 64)) * 8, np.uint8)
    small = np.packbits(bits, bitorder="little")
    out[: len(small)] = small
    return out.view("<u8")


def build(rows: np.ndarray, hashes: np.ndarray, n_rows: int) -> bytes:
    """The index of documents' words (row, hash), sorted by row, as bytes."""
    vocabulary, which = np.unique(hashes, return_inverse=True)
    sizes = np.bincount(rows, minlength=n_rows)
    starts = np.append(0, np.cumsum(sizes + 1))
    symbols = np.zeros(starts[-1], np.uint32)
    symbols[np.arange(len(rows)) + rows] = which + 1
    order = suffix_array(symbols)
    transform = symbols[order - 1]
    known = np.arange(starts[-1]) % SAMPLED == 0
    known[starts[:-1]] = True
    sampled = known[order]
    levels, zeros = [], []
    for level in reversed(range(int(len(vocabulary)).bit_length())):
        bit = (transform >> np.uint32(level)) & np.uint32(1) == 1
        levels.append(bit_words(bit))
        rest = transform[~bit]
        zeros.append(len(rest))
        transform = np.concatenate([rest, transform[bit]])
    counts = np.bincount(symbols, minlength=len(vocabulary) + 1)
    return packed(vocabulary, counts.astype(np.uint32), levels, zeros, bit_words(sampled), order[sampled].astype(np.uint32 if len(order) < 1 << 32 else np.int64), starts)


class Index:
    """What `build` made, for searching."""

    def __init__(self, payload: bytes):
        self.vocabulary, counts, levels, self.zeros, sampled, self.samples, self.starts = unpacked(payload)
        counts = counts.astype(np.int64)
        self.levels, self.sampled, self.n = [Bits(x) for x in levels], Bits(sampled), int(self.starts[-1])
        # A symbol's rows start at `first` in the suffix array, and at `last` behind the last level, which orders symbols by their reversed bits.
        reverse = np.zeros(len(counts), np.int64)
        for k in range(len(levels)):
            reverse |= ((np.arange(len(counts)) >> k) & 1) << (len(levels) - 1 - k)
        by = np.argsort(reverse, kind="stable")
        last = np.zeros(len(counts), np.int64)
        last[by] = np.cumsum(counts[by]) - counts[by]
        self.shift = np.cumsum(counts) - counts - last

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The symbols of words; 0 for those the shard has not."""
        if not len(self.vocabulary):
            return np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at + 1, 0)

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a row boundary comes when a symbol is put in front."""
        goes = at
        for k, (level, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = level.rank(goes)
            goes = np.where((symbol >> (len(self.levels) - 1 - k)) & 1 == 1, zeros + ones, goes - ones)
        return goes + self.shift[symbol]

    def back(self, at: np.ndarray) -> np.ndarray:
        """The row of the suffix that is one word longer."""
        symbol, goes = np.zeros(len(at), np.int64), at
        for level, zeros in zip(self.levels, self.zeros):
            bit, ones = level.get(goes).astype(np.int64), level.rank(goes)
            symbol = symbol * 2 + bit
            goes = np.where(bit == 1, zeros + ones, goes - ones)
        return goes + self.shift[symbol]

    def ranges(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first row, row after the last) of phrases: rows of hashes, aligned at their end; equal where a phrase does not occur."""
        found = self.symbols(words)
        wide = words.shape[1]
        within = np.arange(wide) >= wide - lengths[:, None]
        low, high = np.zeros(len(words), np.int64), np.full(len(words), self.n)
        high[((found == 0) & within).any(1) | (lengths == 0)] = 0
        for k in range(wide - 1, -1, -1):
            live = np.flatnonzero((high > low) & within[:, k])
            both = self.step(np.tile(found[live, k], 2), np.concatenate([low[live], high[live]]))
            low[live], high[live] = both[: len(live)], both[len(live) :]
        return low, high

    def positions(self, at: np.ndarray) -> np.ndarray:
        """The positions of suffixes by their rows: steps back to a sampled one, whose position is stored."""
        out, todo, steps = np.empty(len(at), np.int64), np.arange(len(at)), 0
        at = at.copy()
        while len(todo):
            known = self.sampled.get(at) == 1
            out[todo[known]] = self.samples[self.sampled.rank(at[known])].astype(np.int64) + steps
            todo, at = todo[~known], self.back(at[~known])
            steps += 1
        return out
