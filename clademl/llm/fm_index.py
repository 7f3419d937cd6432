"""FM-index over integer symbols: suffix array, wavelet matrix, backward search, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Start positions in suffix order (prefix doubling; a shorter suffix sorts first)."""
    n = len(seq)
    rank, step = np.unique(seq, return_inverse=True)[1].astype(np.int64) + 1, 1
    while True:
        nxt = np.zeros(n, np.int64)
        nxt[: max(0, n - step)] = rank[step:]
        key = rank * (n + 2) + nxt
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.concatenate(([1], 1 + np.cumsum(np.diff(key[order]) != 0))) if n else []
        if n == 0 or new[order[-1]] == n:
            return order
        rank, step = new, step * 2


class Bits:
    """A bit vector with rank: packed 64-bit words and the ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))))
        self.zeros = len(bits) - int(self.before[-1])

    def rank1(self, i: np.ndarray) -> np.ndarray:
        """Ones in the first ``i`` bits."""
        w, r = i >> 6, (i & 63).astype(np.uint64)
        return self.before[w] + np.bitwise_count(self.words[w] & ((np.uint64(1) << r) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)


class WaveletMatrix:
    """Symbol rank and access in one step per bit of the alphabet."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.levels: list[Bits] = []
        self.depth = max(1, int(sigma).bit_length())
        x = np.asarray(seq, np.int64)
        for b in range(self.depth - 1, -1, -1):
            bit = (x >> b & 1).astype(bool)
            self.levels.append(Bits(bit))
            x = np.concatenate((x[~bit], x[bit]))

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of ``symbol`` before ``i``, element by element."""
        lo, hi = np.zeros_like(i), i
        for b, level in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            one = (symbol >> b & 1).astype(bool)
            l1, h1 = level.rank1(lo), level.rank1(hi)
            lo, hi = np.where(one, level.zeros + l1, lo - l1), np.where(one, level.zeros + h1, hi - h1)
        return hi - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols at ``i`` and their ranks there."""
        symbol, at, lo = np.zeros_like(i), i, np.zeros_like(i)
        for b, level in zip(range(self.depth - 1, -1, -1), self.levels, strict=True):
            one = level.get(at).astype(bool)
            symbol = symbol | (one.astype(np.int64) << b)
            a1, l1 = level.rank1(at), level.rank1(lo)
            at, lo = np.where(one, level.zeros + a1, at - a1), np.where(one, level.zeros + l1, lo - l1)
        return symbol, at - lo


class FMIndex:
    """Full-text index of ``seq`` (symbols from 1; 0 separates and is never searched).

    Keeps the transform's wavelet matrix and each suffix position that is divisible by ``every``.
    """

    def __init__(self, seq: np.ndarray, sigma: int, every: int = 16):
        seq = np.concatenate((np.asarray(seq, np.int64) + 1, [0]))  # a unique smallest end
        order = suffix_array(seq)
        self.n = len(seq)
        self.tree = WaveletMatrix(seq[order - 1], sigma + 1)
        counts = np.bincount(seq, minlength=sigma + 2)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        sampled = order % every == 0
        self.sampled, self.samples = Bits(sampled), order[sampled]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals ``[lo, hi)`` of the rows of ``patterns`` (one width)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for column in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[live, column] + 1
            lo[live] = self.first[symbol] + self.tree.rank(symbol, lo[live])
            hi[live] = self.first[symbol] + self.tree.rank(symbol, hi[live])
            live = live[lo[live] < hi[live]]
        hi = np.maximum(lo, hi)
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to the nearest sampled one."""
        out, at, steps, left = np.empty(len(rows), np.int64), rows.astype(np.int64), 0, np.arange(len(rows))
        while len(left):
            hit = self.sampled.get(at).astype(bool)
            out[left[hit]] = self.samples[self.sampled.rank1(at[hit])] + steps
            left, at = left[~hit], at[~hit]
            if len(left):
                symbol, rank = self.tree.access(at)
                at = self.first[symbol] + rank
            steps += 1
        return out
