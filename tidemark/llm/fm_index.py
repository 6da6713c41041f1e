"""An FM-index over integer sequences: wavelet-matrix ranks, vectorised backward search, sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; a shorter suffix sorts before a longer one that it begins."""
    n = len(s)
    rank = np.unique(s, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] if k < n else 0
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.r_[1, 1 + np.cumsum(sorted_key[1:] != sorted_key[:-1])]
        rank = new
        if rank[order[-1]] == n or k >= n:
            return order
        k *= 2


class Bits:
    """A bit vector with constant-time rank: a count for every word of 64 bits."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.r_[0, np.cumsum(np.bitwise_count(self.words).astype(np.int64))]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Number of ones among the first i bits."""
        word, rest = i >> 6, (i & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        return ((self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)


class WaveletMatrix:
    """Rank and access of a sequence over [0, 2**levels), one bit vector a level, highest bit first."""

    def __init__(self, s: np.ndarray, levels: int) -> None:
        self.levels, self.bits, self.zeros = levels, [], []
        for level in reversed(range(levels)):
            bit = (s >> level) & 1
            self.bits.append(Bits(bit))
            self.zeros.append(int(len(s) - bit.sum()))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands among the first i places."""
        start = np.zeros_like(i)
        for k, level in enumerate(reversed(range(self.levels))):
            one = (symbol >> level) & 1
            r0, r1 = self.bits[k].rank(start), self.bits[k].rank(i)
            start = np.where(one, self.zeros[k] + r0, start - r0)
            i = np.where(one, self.zeros[k] + r1, i - r1)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros_like(i)
        for k in range(self.levels):
            one, r = self.bits[k].get(i), self.bits[k].rank(i)
            out = out * 2 + one
            i = np.where(one, self.zeros[k] + r, i - r)
        return out


class FMIndex:
    """Index of a sequence of positive integers; 0 is the end mark and may stand inside as a break."""

    SAMPLE = 8

    def __init__(self, s: np.ndarray) -> None:
        s = np.r_[np.asarray(s, np.int64) + 1, 0]  # 0 is now the end of the whole sequence alone
        self.n = len(s)
        sa = suffix_array(s)
        bwt = s[sa - 1]
        top = int(s.max())
        self.wavelet = WaveletMatrix(bwt, max(1, top.bit_length()))
        self.first = np.r_[0, np.cumsum(np.bincount(s, minlength=top + 1))]
        marked = sa % self.SAMPLE == 0
        self.marked, self.samples = Bits(marked.astype(np.uint8)), sa[marked]

    def _step(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self.wavelet.rank(symbol, i)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range [low, high) of each row of a matrix of phrases, all rows stepped together from their end."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            symbol = phrases[live, k] + 1
            inside = symbol < len(self.first) - 1
            low[live[~inside]] = high[live[~inside]] = 0
            live, symbol = live[inside], symbol[inside]
            low[live], high[live] = self._step(symbol, low[live]), self._step(symbol, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        high = np.maximum(high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows: walked back to the nearest sampled position."""
        out, steps, at = np.full(len(rows), -1, np.int64), 0, rows.astype(np.int64)
        live = np.arange(len(rows))
        while len(live):
            here = self.marked.get(at[live]) == 1
            done = live[here]
            out[done] = self.samples[self.marked.rank(at[done])] + steps
            live = live[~here]
            symbol = self.wavelet.access(at[live])
            at[live] = self._step(symbol, at[live])
            steps += 1
        return out
