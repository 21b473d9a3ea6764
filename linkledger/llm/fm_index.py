"""A full-text index over word sequences: a wavelet matrix over the Burrows-Wheeler transform, searched backwards."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Ranks of symbols in a sequence, one packed bit row per binary digit of a symbol."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.digits = max(1, int(alphabet - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        rest = symbols
        for digit in reversed(range(self.digits)):
            bit = (rest >> digit & 1).astype(np.uint8)
            packed = np.packbits(bit, bitorder="little")
            packed = np.concatenate([packed, np.zeros(16 - len(packed) % 8, np.uint8)]).view("<u8")
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)])[:-1])
            self.zeros.append(int(len(bit) - bit.sum()))
            rest = np.concatenate([rest[bit == 0], rest[bit == 1]])
        self.base = np.zeros(alphabet, np.int64)
        every = np.arange(alphabet)
        self.base = self._follow(every, np.zeros(alphabet, np.int64))

    def _follow(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, digit in enumerate(reversed(range(self.digits))):
            ones = self.counts[i][at >> 6] + np.bitwise_count(self.words[i][at >> 6] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where(symbols >> digit & 1, self.zeros[i] + ones.astype(np.int64), at - ones.astype(np.int64))
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before its position."""
        return self._follow(symbols, at) - self.base[symbols]


def _sparse_minima(values: np.ndarray) -> list[np.ndarray]:
    """Minima of all runs whose length is a power of two."""
    rows = [values]
    while 2 << (len(rows) - 1) <= len(values):
        half = 1 << (len(rows) - 1)
        rows.append(np.minimum(rows[-1][:-half], rows[-1][half:]))
    return rows


class FMIndex:
    """Of a shard of word sequences, each with an owner: which sequences occur in it, and their least owner.

    Symbols are numbered from 1; 0 ends a sequence. ``depth`` is the longest match that is told apart.
    """

    def __init__(self, sequences: list[np.ndarray], owners: list[int], alphabet: int, depth: int):
        self.depth = depth
        m = len(sequences)
        text = np.concatenate([x for s in sequences for x in (s, [0])]).astype(np.int64)
        n = len(text)
        ends = np.cumsum([len(s) + 1 for s in sequences]) - 1
        rank = text + m
        rank[ends] = np.arange(m)  # ends differ from each other, so no match runs over one
        ranks = []  # ranks of all suffixes by their first 1, 2, 4, ... symbols
        step, order = 1, None
        while True:
            values, rank = np.unique(rank, return_inverse=True)
            ranks.append(rank)
            if len(values) == n:
                break
            later = np.zeros(n, np.int64)
            later[:-step] = rank[step:] + 1
            rank = rank * (n + 1) + later
            step *= 2
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        self.size = n
        before = text[order - 1]  # the transform; the first suffix is preceded by the last end
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))]).astype(np.int64)
        self.wavelet = WaveletMatrix(before, alphabet)
        owner = np.repeat(np.asarray(owners, np.int64), [len(s) + 1 for s in sequences])
        self.owners = _sparse_minima(owner[order])
        self.common = self._common_prefixes(order, ranks)
        self.minima = _sparse_minima(self.common)
        breaks = np.concatenate([np.flatnonzero(self.common < depth), [n]])  # a match of full depth lies between two of them
        self.block = np.searchsorted(breaks, np.arange(n), side="right")
        self.breaks = breaks

    @staticmethod
    def _common_prefixes(order: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
        """Length of the prefix that each suffix shares with the one before it in order; -1 for the first."""
        n = len(order)
        a, b, out = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.int64)
        for power in reversed(range(len(ranks))):
            inside = (a < n) & (b < n)
            equal = inside & (ranks[power][np.minimum(a, n - 1)] == ranks[power][np.minimum(b, n - 1)])
            out[1:] += equal.astype(np.int64) << power
            a += equal.astype(np.int64) << power
            b += equal.astype(np.int64) << power
        out[0] = -1
        return out

    def backward(self, low: np.ndarray, high: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the sequences with one more symbol in front."""
        return self.less[symbols] + self.wavelet.rank(symbols, low), self.less[symbols] + self.wavelet.rank(symbols, high)

    def widen(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the first ``depth`` symbols of what the given intervals match."""
        low, high = low.copy(), high.copy()
        for power in reversed(range(len(self.minima))):
            row, step = self.minima[power], 1 << power
            at = low - step + 1
            move = (at >= 0) & (row[np.maximum(at, 0)] >= depth)
            low -= step * move
            move = (high + step <= self.size) & (row[np.minimum(high, len(row) - 1)] >= depth)
            high += step * move
        return low, high

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        out = np.empty(len(low), np.int64)
        power = np.frexp((high - low).astype(float))[1] - 1
        for p in np.unique(power):
            of = power == p
            row = self.owners[p]
            out[of] = np.minimum(row[low[of]], row[high[of] - (1 << p)])
        return out

    def matching_statistics(self, queries: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """(lengths, owners) per query and position: the longest match from there, up to the depth, and, where it has
        the full depth, the least owner of a sequence that holds it (else -1). Symbols below 1 match nothing.

        All queries are read at once, from right to left: each match is extended by one symbol in front, or cut at its
        end until that is possible.
        """
        sizes = np.array([len(q) for q in queries], np.int64)
        lengths = [np.zeros(n, np.int64) for n in sizes]
        owners = [np.full(n, -1, np.int64) for n in sizes]
        if not len(sizes) or not sizes.max():
            return lengths, owners
        longest = int(sizes.max())
        grid = np.zeros((len(queries), longest), np.int64)
        for i, q in enumerate(queries):
            grid[i, longest - len(q):] = q
        found, owner = np.zeros_like(grid), np.full_like(grid, -1)
        low, high, depth = np.zeros(len(queries), np.int64), np.full(len(queries), self.size), np.zeros(len(queries), np.int64)
        for column in reversed(range(longest)):
            live = np.flatnonzero(sizes >= longest - column)
            symbol = grid[live, column]
            while len(live):
                at = symbol > 0
                low[live[~at]], high[live[~at]], depth[live[~at]] = 0, self.size, 0
                live, symbol = live[at], symbol[at]
                new_low, new_high = self.backward(low[live], high[live], symbol)
                fits = new_high > new_low
                done = live[fits]
                low[done], high[done] = new_low[fits], new_high[fits]
                depth[done] += 1
                over = done[depth[done] > self.depth]
                block = self.block[low[over]]
                low[over], high[over], depth[over] = self.breaks[block - 1], self.breaks[block], self.depth
                found[done, column] = depth[done]
                full = done[depth[done] == self.depth]
                owner[full, column] = self.least_owner(low[full], high[full])
                live, symbol = live[~fits], symbol[~fits]
                alone = depth[live] == 0  # the symbol does not occur at all
                live, symbol = live[~alone], symbol[~alone]
                if len(live):
                    right = np.where(high[live] < self.size, self.common[np.minimum(high[live], self.size - 1)], -1)
                    depth[live] = np.maximum(0, np.maximum(self.common[low[live]], right))
                    low[live], high[live] = self.widen(low[live], high[live], depth[live])
        for i, n in enumerate(sizes):
            lengths[i], owners[i] = found[i, longest - n:], owner[i, longest - n:]
        return lengths, owners
