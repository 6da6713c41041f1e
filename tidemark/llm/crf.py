"""Conditional random fields over word sequences, in NumPy.

`ChainCRF` is a linear chain; `skip_chain_marginals` adds potentials between distant tokens and passes messages over
the loopy graph. The emission of a token is a sum over window offsets of weights of hashed features of the word at that
offset, so features are taken once for each distinct word, never for each token. All sequences of a batch are stepped
together, shorter ones masked.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import xxhash

Featurizer = Callable[[str], list[str]]


def _ragged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(lists), np.r_[0, np.cumsum([len(x) for x in lists])[:-1]]


def plan(lengths: Sequence[int], cells: int = 60_000) -> list[np.ndarray]:
    """Groups of sequences of like length, each of at most ``cells`` padded tokens (or of one sequence)."""
    order = np.argsort(np.asarray(lengths), kind="stable")
    groups, at = [], 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * lengths[order[end]] <= cells:
            end += 1
        groups.append(order[at:end])
        at = end
    return groups


def forward_backward(emission: np.ndarray, lengths: np.ndarray, trans: np.ndarray, kind: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals [n, T, L], expected transitions [K, L, L] and log partition [n].

    emission: log potentials [n, T, L]; trans: log potentials [K, L, L]; kind[n, t]: which of them leads into token t.
    """
    n, T, L = emission.shape
    peak = emission.max(axis=2, keepdims=True)
    e = np.exp(emission - peak)
    a = np.exp(trans)
    alpha, beta, scale = np.empty((T, n, L)), np.ones((T, n, L)), np.ones((T, n))
    valid = np.arange(T)[:, None] < lengths[None, :]
    cur = np.exp(start)[None, :] * e[:, 0]
    scale[0] = cur.sum(1)
    alpha[0] = cur / scale[0][:, None]
    for t in range(1, T):
        step = alpha[t - 1] @ a[0]
        for k in range(1, len(a)):
            other = kind[:, t] == k
            if other.any():
                step[other] = alpha[t - 1][other] @ a[k]
        cur = step * e[:, t]
        s = cur.sum(1)
        live = valid[t]
        scale[t] = np.where(live, s, 1.0)
        alpha[t] = np.where(live[:, None], cur / s[:, None], alpha[t - 1])
    pair = np.zeros_like(a)
    for t in range(T - 1, 0, -1):
        live = valid[t]
        msg = np.where(live[:, None], beta[t] * e[:, t] / scale[t][:, None], 1.0)
        back = msg @ a[0].T
        for k in range(len(a)):
            rows = live & (kind[:, t] == k)
            if not rows.any():
                continue
            if k:
                back[rows] = msg[rows] @ a[k].T
            pair[k] += a[k] * (alpha[t - 1][rows].T @ msg[rows])
        beta[t - 1] = np.where(live[:, None], back, beta[t - 1])
    marginals = alpha * beta
    marginals /= marginals.sum(2, keepdims=True)
    logz = (np.log(scale) * valid).sum(0) + (peak[:, :, 0] * valid.T).sum(1)
    return marginals.transpose(1, 0, 2), pair, logz


class ChainCRF:
    """A linear-chain CRF whose weights are learned by Adam on the exact likelihood."""

    def __init__(self, labels: list[str], featurize: Featurizer, offsets: tuple[int, ...] = (0,), bits: int = 17, kinds: int = 1) -> None:
        self.labels, self.featurize, self.offsets, self.bits, self.kinds = labels, featurize, offsets, bits, kinds
        L = len(labels)
        self.weights = np.zeros((len(offsets), 1 << bits, L), np.float32)
        self.trans = np.zeros((kinds, L, L))
        self.start = np.zeros(L)
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((len(self.offsets), 0, len(self.labels)), np.float32)
        self.pending: list[str] = []

    def __getstate__(self) -> dict:
        state = self.__dict__.copy()
        live = self.weights.any(axis=(0, 2))  # only rows with a weight travel
        rows = np.flatnonzero(live)
        state["weights"] = (rows, self.weights[:, rows])
        for k in ("known", "table", "pending"):
            state.pop(k)
        return state

    def __setstate__(self, state: dict) -> None:
        rows, values = state.pop("weights")
        self.__dict__.update(state)
        self.weights = np.zeros((len(self.offsets), 1 << self.bits, len(self.labels)), np.float32)
        self.weights[:, rows] = values
        self._reset()

    def hashed(self, word: str) -> np.ndarray:
        mask = (1 << self.bits) - 1
        return np.array([xxhash.xxh32_intdigest(f) & mask for f in self.featurize(word)], np.int64)

    def _scores(self, words: list[str]) -> np.ndarray:
        flat, starts = _ragged([self.hashed(w) for w in words])
        return np.add.reduceat(self.weights[:, flat], starts, axis=1)

    #: distinct words kept between batches; beyond it the table is begun anew (a memory bound, not a cap on the data)
    KEPT = 200_000

    def ids(self, words: list[str]) -> np.ndarray:
        """Numbers of words in the score table; new words are scored."""
        known = self.known
        if len(known) > self.KEPT:
            self._reset()
            known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        if fresh:
            for w in fresh:
                known[w] = len(known)
            self.table = np.concatenate([self.table, self._scores(fresh)], axis=1)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def emissions(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """Log potentials of each sequence. Words beyond either end count as the empty word."""
        if not sequences:
            return []
        flat = [w for s in sequences for w in s]
        ids = self.ids([*flat, ""])
        pad, ids = ids[-1], ids[:-1]
        ends = np.cumsum([len(s) for s in sequences])
        begins = ends - [len(s) for s in sequences]
        place = np.arange(len(ids))
        low, high = np.repeat(begins, ends - begins), np.repeat(ends, ends - begins)
        total = np.zeros((len(ids), len(self.labels)), np.float32)
        for k, o in enumerate(self.offsets):
            at = place + o
            inside = (at >= low) & (at < high)
            total += self.table[k][np.where(inside, ids[np.clip(at, 0, len(ids) - 1)] if len(ids) else pad, pad)]
        return np.split(total, ends[:-1])

    def marginals(self, sequences: list[list[str]], kinds: list[np.ndarray] | None = None) -> list[np.ndarray]:
        """Posterior label probabilities [len, L] of each sequence by forward-backward."""
        emissions = self.emissions(sequences)
        out: list[np.ndarray] = [np.zeros((0, len(self.labels)))] * len(sequences)
        lengths = [len(s) for s in sequences]
        for group in plan(lengths):
            n = np.array([lengths[i] for i in group])
            if not n.max():
                continue
            e = np.zeros((len(group), n.max(), len(self.labels)))
            kind = np.zeros((len(group), n.max()), np.int8)
            for r, i in enumerate(group):
                e[r, : n[r]] = emissions[i]
                if kinds is not None:
                    kind[r, : n[r]] = kinds[i]
            n = np.maximum(n, 1)
            m, _, _ = forward_backward(e, n, self.trans, kind, self.start)
            for r, i in enumerate(group):
                out[i] = m[r, : lengths[i]]
        return out

    def fit(self, sequences: list[list[str]], gold: list[np.ndarray], kinds: list[np.ndarray] | None = None, epochs: int = 60, rate: float = 0.15, l2: float = 2e-5) -> ChainCRF:
        """Maximise the likelihood of labelled sequences (all non-empty)."""
        L = len(self.labels)
        vocabulary: dict[str, int] = {"": 0}
        flat = [vocabulary.setdefault(w, len(vocabulary)) for s in sequences for w in s]
        ids = np.array(flat)
        lengths = np.array([len(s) for s in sequences])
        ends = np.cumsum(lengths)
        place = np.arange(len(ids))
        low, high = np.repeat(ends - lengths, lengths), np.repeat(ends, lengths)
        slots = []
        for o in self.offsets:
            at = place + o
            slots.append(np.where((at >= low) & (at < high), ids[np.clip(at, 0, len(ids) - 1)], 0))
        features, starts = _ragged([self.hashed(w) for w in vocabulary])
        used, compact = np.unique(features, return_inverse=True)
        word_of = np.repeat(np.arange(len(vocabulary)), np.diff(np.r_[starts, len(features)]))
        gold_flat = np.concatenate(gold)
        params = [np.zeros((len(self.offsets), len(used), L)), self.trans.copy(), self.start.copy()]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        groups = plan(lengths)
        kind_flat = np.concatenate(kinds).astype(np.int8) if kinds is not None else np.zeros(len(ids), np.int8)
        begins = ends - lengths
        for epoch in range(1, epochs + 1):
            w, trans, start = params
            tables = [np.add.reduceat(w[k][compact], starts, axis=0) for k in range(len(self.offsets))]
            emission = sum(t[s] for t, s in zip(tables, slots))
            residual = np.zeros((len(ids), L))
            g_trans, g_start = np.zeros_like(trans), np.zeros_like(start)
            for group in groups:
                n = lengths[group]
                grid = begins[group][:, None] + np.arange(n.max())[None, :]
                mask = np.arange(n.max())[None, :] < n[:, None]
                grid = np.where(mask, grid, 0)
                e = np.where(mask[:, :, None], emission[grid], 0.0)
                kind = np.where(mask, kind_flat[grid], 0)
                m, pair, _ = forward_backward(e, n, trans, kind, start)
                residual[grid[mask]] = m[mask]
                g_trans += pair
                g_start += m[:, 0].sum(0)
                y = np.where(mask, gold_flat[grid], 0)
                both = mask[:, 1:]
                np.subtract.at(g_trans, (kind[:, 1:][both], y[:, :-1][both], y[:, 1:][both]), 1.0)
                np.subtract.at(g_start, y[:, 0], 1.0)
            residual[np.arange(len(ids)), gold_flat] -= 1.0
            g_w = np.empty_like(w)
            for k, slot in enumerate(slots):
                by_word = np.stack([np.bincount(slot, residual[:, j], len(vocabulary)) for j in range(L)], 1)
                g_w[k] = np.stack([np.bincount(compact, by_word[word_of, j], len(used)) for j in range(L)], 1)
            n = len(ids)
            for p, g, (m1, m2) in zip(params, (g_w / n + l2 * w, g_trans / n + l2 * trans, g_start / n + l2 * start), moments):
                m1 += 0.1 * (g - m1)
                m2 += 0.02 * (g * g - m2)
                p -= rate * (m1 / (1 - 0.9**epoch)) / (np.sqrt(m2 / (1 - 0.98**epoch)) + 1e-6)
        self.weights[:, used] = params[0]
        self.trans, self.start = params[1], params[2]
        self._reset()
        return self


def chain_marginals(potentials: np.ndarray, live: np.ndarray, trans: np.ndarray, enter: np.ndarray, leave: np.ndarray) -> np.ndarray:
    """Marginals [T, L, n] of n chains, the longest first; ``live[t]`` of them have a token t.

    potentials: positive [T, L, n]; trans: positive [L, L]; enter, leave [L, n]: what stands before and behind the chains.
    """
    alpha, into = np.ones_like(potentials), np.ascontiguousarray(trans.T)
    alpha[0] = enter * potentials[0]
    alpha[0] /= alpha[0].sum(0)
    for t in range(1, len(potentials)):
        k = live[t]
        cur = into @ alpha[t - 1, :, :k]
        cur *= potentials[t, :, :k]
        cur /= cur.sum(0)
        alpha[t, :, :k] = cur
    beta = leave.copy()
    alpha[-1, :, : live[-1]] *= beta[:, : live[-1]]
    for t in range(len(potentials) - 1, 0, -1):
        k = live[t]
        back = trans @ (beta[:, :k] * potentials[t, :, :k])
        back /= back.sum(0)
        beta[:, :k] = back
        alpha[t - 1, :, : live[t - 1]] *= beta[:, : live[t - 1]]
    alpha /= alpha.sum(1, keepdims=True)
    return alpha


#: tokens from which a chain is stepped in blocks, and tokens of a block (exact: blocks are joined by their products)
LONG, BLOCK = 4096, 512


def long_marginals(potentials: np.ndarray, trans: np.ndarray, enter: np.ndarray) -> np.ndarray:
    """Marginals [T, L] of one chain of positive potentials [T, L]: its blocks are stepped together."""
    T, L = potentials.shape
    n = -(-T // BLOCK)
    e = np.ones((n * BLOCK, L))
    e[:T] = potentials
    e = np.ascontiguousarray(e.reshape(n, BLOCK, L).transpose(1, 2, 0))
    live = np.where(np.arange(BLOCK) < T - (n - 1) * BLOCK, n, n - 1)
    whole = np.zeros((n, L, L))  # product of a block's potentials and the transitions inside it
    whole[:, range(L), range(L)] = e[0].T
    for t in range(1, BLOCK):
        k = live[t]
        cur = (whole[:k] @ trans) * e[t, :, :k].T[:, None, :]
        whole[:k] = cur / cur.sum((1, 2), keepdims=True)
    first, last = np.ones((L, n)), np.ones((L, n))
    first[:, 0] = enter
    for b in range(1, n):
        v = (first[:, b - 1] @ whole[b - 1]) @ trans
        first[:, b] = v / v.sum()
    for b in range(n - 2, -1, -1):
        v = trans @ (whole[b + 1] @ last[:, b + 1])
        last[:, b] = v / v.sum()
    return chain_marginals(e, live, trans, first, last).transpose(2, 0, 1).reshape(n * BLOCK, L)[:T]


def skip_chain_marginals(
    emissions: list[np.ndarray],
    edges: list[list[tuple[int, int]]],
    trans: np.ndarray,
    start: np.ndarray,
    agree: np.ndarray,
    rounds: int = 4,
) -> list[np.ndarray]:
    """Marginals of chains whose tokens are also tied by skip edges, by loopy belief propagation.

    edges[i]: pairs of token places of chain i; agree: log potential [L, L] of such a pair. A round runs the exact
    chain inference under the messages that came over the skip edges, then renews these messages from both ends.
    Chains without an edge are exact after the first round.
    """
    L = trans.shape[-1]
    out: list[np.ndarray] = [np.zeros((0, L))] * len(emissions)
    lengths = np.array([len(e) for e in emissions], np.int64)
    factor, step, enter = np.exp(agree), np.exp(trans[0]), np.exp(start)
    short, far = np.flatnonzero((lengths > 0) & (lengths < LONG)), np.flatnonzero(lengths >= LONG)
    groups = [short[g][::-1] for g in plan(lengths[short], 400_000)] + [np.array([i]) for i in far]
    for group in groups:
        n, T = lengths[group], lengths[group[0]]
        live = (np.arange(T)[:, None] < n).sum(1)
        base = np.zeros((T, L, len(group)))
        for r, i in enumerate(group):
            base[: n[r], :, r] = emissions[i]
        row = np.array([r for r, i in enumerate(group) for _ in edges[i]], np.int64)
        u = np.array([a for i in group for a, _ in edges[i]], np.int64)
        v = np.array([b for i in group for _, b in edges[i]], np.int64)
        to_u, to_v = np.zeros((len(row), L)), np.zeros((len(row), L))  # log messages
        for _ in range(rounds if len(row) else 1):
            e = base.copy()
            if len(row):
                np.add.at(e, (u, slice(None), row), to_u)
                np.add.at(e, (v, slice(None), row), to_v)
            e -= e.max(1, keepdims=True)
            np.exp(e, out=e)
            if T >= LONG:
                m = long_marginals(e[:, :, 0], step, enter)[:, :, None]
            else:
                m = chain_marginals(e, live, step, np.repeat(enter[:, None], len(group), 1), np.ones((L, len(group))))
            if not len(row):
                break
            fresh = []
            for side, came in ((u, to_u), (v, to_v)):
                belief = np.log(np.maximum(m[side, :, row], 1e-12)) - came
                belief -= belief.max(1, keepdims=True)
                msg = np.log(np.exp(belief) @ factor)
                fresh.append(msg - msg.mean(1, keepdims=True))
            to_u, to_v = 0.5 * (to_u + fresh[1]), 0.5 * (to_v + fresh[0])
        for r, i in enumerate(group):
            out[i] = m[: n[r], :, r]
    return out
