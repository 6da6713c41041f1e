"""Relative Lempel-Ziv parsing of texts against an indexed reference block, for factors of a least length.

A reference block is a set of parts of texts laid end to end. Its index holds the fingerprint of every window of
``least`` code points that lies within a part, sorted, so that equal windows stand together as a group; each window knows
its group and each group the texts it stands in.

A text is factored from left to right: at the first window that the block holds in another text, all its places there are
followed window by window until only the longest match is left, which is then followed by the character to its exact
end and compared whole. The parse goes on at the first window that does not lie inside the factor, so that the factor's
own end is checked as the start of another; what no factor covers is literal.
"""

from __future__ import annotations

import numpy as np

from tidemark.llm.anchors import code_points, fingerprints

#: places of a window compared at once when the longest match is sought
COMPARED = 4096


class ReferenceBlock:
    """The index of a block: parts (texts) with the number of the text each comes from."""

    def __init__(self, owners: np.ndarray, parts: list[str], least: int) -> None:
        self.least = least
        self.codes = code_points("".join(parts))
        sizes = np.array([len(p) for p in parts], np.int64)
        self.ends = np.cumsum(sizes)
        begins = self.ends - sizes
        part_of = np.repeat(np.arange(len(parts)), sizes)
        self.owner = np.asarray(owners, np.int64)[part_of] if len(parts) else np.zeros(0, np.int64)
        self.end_of = self.ends[part_of] if len(parts) else np.zeros(0, np.int64)
        self.group_of = np.full(len(self.codes), -1, np.int64)
        if len(self.codes) < least:
            self.keys, self.starts, self.at = np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int64)
            return
        fp = fingerprints(self.codes, least)
        fits = np.arange(len(fp)) + least <= self.end_of[: len(fp)]
        del begins
        at = np.flatnonzero(fits)
        order = at[np.argsort(fp[at], kind="stable")]
        key = fp[order]
        first = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        self.at, self.keys = order, key[first]
        self.starts = np.r_[np.flatnonzero(first), len(order)]
        self.group_of[order] = np.cumsum(first) - 1
        # the texts of each group, and a number that equal sets of texts have in common
        group = self.group_of[order]
        own = self.owner[order]
        pair = np.lexsort((own, group))
        keep = np.r_[True, (group[pair][1:] != group[pair][:-1]) | (own[pair][1:] != own[pair][:-1])] if len(pair) else np.zeros(0, bool)
        kept = pair[keep]
        self.text, self.text_at = own[kept], order[kept]
        self.text_starts = np.searchsorted(group[kept], np.arange(len(self.keys) + 1))
        mixed = (self.text.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        self.set_of = np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), self.text_starts[:-1]) if len(self.keys) else np.zeros(0, np.uint64)

    def _places(self, group: int, own: int) -> np.ndarray:
        at = self.at[self.starts[group] : self.starts[group + 1]]
        return at[self.owner[at] != own]

    def windows(self, codes: np.ndarray, own: int) -> np.ndarray:
        """For every window of a text its group in the block, -1 if no other text holds it."""
        if len(codes) < self.least or not len(self.keys):
            return np.full(max(0, len(codes) - self.least + 1), -1, np.int64)
        fp = fingerprints(codes, self.least)
        near = np.minimum(np.searchsorted(self.keys, fp), len(self.keys) - 1)
        group = np.where(self.keys[near] == fp, near, -1)
        held = np.diff(self.text_starts)
        alone = (held[near] == 1) & (self.text[self.text_starts[near]] == own)
        return np.where(alone, -1, group)

    def factors(self, codes: np.ndarray, own: int) -> list[tuple[int, int, int]]:
        """Greedy factors (start, place in the block, length) of at least ``least`` against texts other than own."""
        m, group = self.least, self.windows(codes, own)
        todo = np.flatnonzero(group >= 0)
        out: list[tuple[int, int, int]] = []
        k = 0
        while k < len(todo):
            p = int(todo[k])
            places, n = self._places(int(group[p]), own), m
            while p + n + m <= len(codes) and group[p + n] >= 0:  # whole windows first
                on = places + n
                same = places[(on < len(self.group_of)) & (self.group_of[np.minimum(on, len(self.group_of) - 1)] == group[p + n])]
                same = same[self.end_of[same] - same >= n + m]
                if not len(same):
                    break
                places, n = same, n + m
            best, source = 0, int(places[0])
            for i in range(0, len(places), COMPARED):
                some = places[i : i + COMPARED]
                reach = int(min(m - 1, len(codes) - p - n))
                if reach <= 0:
                    break
                grid = np.minimum(some[:, None] + n + np.arange(reach)[None, :], len(self.codes) - 1)
                same = (self.codes[grid] == codes[p + n : p + n + reach][None, :]) & (some[:, None] + n + np.arange(reach)[None, :] < self.end_of[some][:, None])
                run = np.where(same.all(1), reach, same.argmin(1))
                if run.max() > best:
                    best, source = int(run.max()), int(some[run.argmax()])
            n += best
            if np.array_equal(codes[p : p + n], self.codes[source : source + n]):
                out.append((p, source, n))
                k = int(np.searchsorted(todo, p + n - m + 1))
            else:  # an accident of fingerprints
                k += 1
        return out

    def texts_with(self, codes: np.ndarray, factor: tuple[int, int, int], own: int) -> np.ndarray:
        """Numbers of all other texts of the block that hold a window of a factor, each compared by the character."""
        start, source, n = factor
        group = self.group_of[source : source + n - self.least + 1]
        _, first = np.unique(self.set_of[group], return_index=True)
        found: list[np.ndarray] = []
        for i in first.tolist():
            a, b = self.text_starts[group[i]], self.text_starts[group[i] + 1]
            text, at = self.text[a:b], self.text_at[a:b]
            want = codes[start + i : start + i + self.least]
            for j in range(0, len(text), COMPARED):
                grid = at[j : j + COMPARED, None] + np.arange(self.least)[None, :]
                found.append(text[j : j + COMPARED][(self.codes[grid] == want[None, :]).all(1)])
        out = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return out[out != own]
