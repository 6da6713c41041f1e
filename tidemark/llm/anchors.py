"""Content anchors: positions chosen by the text itself, so that equal stretches hold equal anchors.

A rolling fingerprint is taken of every window of ``width`` characters; of each run of ``run`` neighbouring windows the
one with the least fingerprint is an anchor. Two texts that share ``width + run - 1`` characters share a whole run of
windows, hence the least of them: no shared stretch of that length is without a common anchor (winnowing).
"""

from __future__ import annotations

import numpy as np

_M64 = (1 << 64) - 1
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POS_BITS = np.uint64((1 << 24) - 1)
#: characters fingerprinted at once; positions must fit 24 bits
PIECE = 2_000_000

_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, n: int, name: str) -> np.ndarray:
    known = _powers.get(name)
    if known is None or len(known) < n:
        p = np.full(max(n, 1 << 16), base, np.uint64)
        p[0] = 1
        known = _powers[name] = np.multiply.accumulate(p)
    return known[:n]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprints(codes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit fingerprint of every window of ``width`` code points."""
    n = len(codes)
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(x * _power(_BASE, n, "base"), out=sums[1:])
    h = (sums[width:] - sums[:-width]) * _power(_INVERSE, n - width + 1, "inverse")
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by prefix and suffix minima of blocks of w."""
    n = len(a)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.uint64(_M64))
    padded[:n] = a
    grid = padded.reshape(blocks, w)
    prefix = np.minimum.accumulate(grid, axis=1).ravel()
    suffix = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(suffix[: n - w + 1], prefix[w - 1 : n])


def anchors(texts: list[str], width: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, position, fingerprint) of every anchor of every text; texts shorter than width + run - 1 have none."""
    need = width + run - 1
    pieces: list[tuple[int, int, str]] = []
    for i, t in enumerate(texts):
        if len(t) < need:
            continue
        if len(t) <= PIECE:
            pieces.append((i, 0, t))
        else:  # overlapping pieces: each run of windows lies whole in one of them
            pieces += [(i, s, t[s : s + PIECE]) for s in range(0, len(t) - need + 1, PIECE - need + 1)]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at = 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + len(pieces[end][2]) < PIECE):
            size += len(pieces[end][2])
            end += 1
        group = pieces[at:end]
        at = end
        codes = code_points("".join(p[2] for p in group))
        lengths = np.array([len(p[2]) for p in group])
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        h = fingerprints(codes, width)
        keyed = (h & ~_POS_BITS) | np.arange(len(h), dtype=np.uint64)
        least = _sliding_min(keyed, run)
        whole = np.zeros(len(least), bool)  # runs that do not cross from one text into the next
        for s, n in zip(starts, lengths):
            whole[s : s + n - need + 1] = True
        pos = np.unique(least[whole] & _POS_BITS).astype(np.int64)
        piece = np.searchsorted(starts, pos, side="right") - 1
        owner = np.array([p[0] for p in group])[piece]
        offset = np.array([p[1] for p in group])[piece]
        out.append((owner, pos - starts[piece] + offset, h[pos]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(0, np.uint64)
    owner, pos, h = (np.concatenate(x) for x in zip(*out))
    _, first = np.unique(np.stack([owner, pos]), axis=1, return_index=True)  # overlaps give some anchors twice
    return owner[first], pos[first], h[first]
