"""MinHash signatures of word shingles and banding keys, in NumPy."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: words of a shingle, least similarity of a near copy
SHINGLE, SIMILAR = 5, 0.8
#: with 16 bands of 6 rows a pair of similarity 0.8 is met with probability 0.992, one of 0.5 with 0.22
BANDS, ROWS = 16, 6
#: words of the shortest head of a text that is sketched
HEAD = 16

WORD = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")


def words(text: str) -> list[str]:
    """Words in lower case; Chinese characters stand alone."""
    return WORD.findall(text.lower())


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1), r.integers(0, 2**63, n, dtype=np.uint64)


_A, _B = _coefficients(BANDS * ROWS)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


class Sketcher:
    """Band keys of texts; hashes of words are kept between batches."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def shingles(self, text: str) -> np.ndarray:
        """Hashes of the distinct shingles of a text (of all its words together if there are fewer than SHINGLE)."""
        w = words(text)
        if not w:
            return np.zeros(0, np.uint64)
        h = self.hashes(w)
        k = min(SHINGLE, len(h))
        out = np.zeros(len(h) - k + 1, np.uint64)
        for i in range(k):
            out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
        return np.unique(out)

    def hashes(self, w: list[str]) -> np.ndarray:
        if len(self.known) > 500_000:
            self.known = {}
        known = self.known
        for x in w:
            if x not in known:
                known[x] = xxhash.xxh64_intdigest(x)
        return np.fromiter(map(known.__getitem__, w), np.uint64, len(w))

    def head_bands(self, texts: list[str], top_only: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Band keys of the heads of texts and of the whole texts: (text index, words of the head, head's key, band keys [n, BANDS]).

        Heads have HEAD, 2 HEAD, 4 HEAD ... words, as far as the text goes; a text under HEAD words has none. The head's
        key is a hash of the first three heads' worth of words. top_only: only the longest head and the whole text.

        A text cut anywhere behind its first HEAD words has the head of half its length or more in common with its
        original, wherever it was cut; as minima of a longer head include those of a shorter one, all heads cost one pass.
        """
        rows = [w for w in (self.hashes(words(t)) for t in texts)]
        have = [i for i, h in enumerate(rows) if len(h) >= HEAD]
        if not have:
            z = np.zeros(0, np.int64)
            return z, z, z, np.zeros((0, BANDS), np.int64)
        h = np.concatenate([rows[i] for i in have])
        sizes = np.array([len(rows[i]) for i in have], np.int64)
        begins = np.cumsum(sizes) - sizes
        grams = np.zeros(len(h) - SHINGLE + 1, np.uint64)
        for i in range(SHINGLE):
            grams = _mix(grams * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - SHINGLE + 1 + i])
        levels = np.floor(np.log2(sizes / HEAD)).astype(np.int64) + 1
        widest = int(levels.max()) + 1
        # stretch k of a text: the grams that head k has more than head k - 1; the last is what the whole text has more
        ends = np.minimum(HEAD * 2 ** np.arange(widest)[None, :], sizes[:, None])
        ends[np.arange(len(have)), levels] = sizes
        ends -= SHINGLE - 1
        starts = np.c_[np.zeros(len(have), np.int64), ends[:, :-1]]
        live = (np.arange(widest)[None, :] <= levels[:, None]) & (ends > starts)
        flat = np.empty(2 * int(live.sum()), np.int64)
        flat[0::2] = (begins[:, None] + starts)[live]
        flat[1::2] = (begins[:, None] + ends)[live]
        kept = live.copy()
        if top_only:
            kept &= np.arange(widest)[None, :] >= levels[:, None] - 1
        keys = np.zeros((int(kept.sum()), BANDS), np.uint64)
        which, level = np.nonzero(kept)
        whole = level == levels[which]
        salt = np.where(whole, 63, level).astype(np.uint64)
        tail = np.append(flat, 0)[:-1]
        closed = np.append(grams, np.uint64(0))  # so that a stretch may end with the last gram
        for band in range(BANDS):
            key = salt + np.uint64(64 * (band + 1))
            for row in range(ROWS):
                k = band * ROWS + row
                least = np.full(live.shape, np.uint64(0xFFFFFFFFFFFFFFFF))
                least[live] = np.minimum.reduceat(_mix(closed * _A[k] + _B[k]), tail)[0::2]
                key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.accumulate(least, axis=1)[kept])
            keys[:, band] = key
        span = np.where(whole, sizes[which], HEAD * 2**level)
        run = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(_mix(h + np.arange(len(h), dtype=np.uint64) - np.repeat(begins, sizes).astype(np.uint64)), out=run[1:])
        head = run[begins[which] + np.minimum(3 * span, sizes[which])] - run[begins[which]]
        return np.array(have, np.int64)[which], np.where(whole, 0, span), head.view(np.int64), keys.view(np.int64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the shingles of a that b holds too."""
    return len(np.intersect1d(a, b, assume_unique=True)) / max(1, len(a))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)
