"""BK-trees over 64-bit codes, many at once, in flat arrays.

A node's children are keyed by their Hamming distance to it.  All trees of a forest grow together,
level by level, into the trees that inserting the codes one by one would give; a search follows, from
each tree's root, only the edges whose distance differs from the query's by no more than the radius.
"""

from __future__ import annotations

import numpy as np

_EDGES = 65  # distances of 64-bit codes
FRONTIER = 1 << 19  # (query, node) pairs looked at together


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """One tree for each group of distinct codes; the codes of a group stand together."""

    def __init__(self, codes: np.ndarray, groups: np.ndarray):
        self.codes = codes
        n = len(codes)
        first = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if n else np.zeros(0, np.int64)
        #: The root of every code's tree.
        self.root = np.repeat(first, np.diff(np.append(first, n)))
        at = self.root.copy()
        waiting = np.setdiff1d(np.arange(n), first, assume_unique=True)
        slots, kids = [], []
        while len(waiting):
            edge = at[waiting] * _EDGES + distances(codes[waiting], codes[at[waiting]])
            taken, earliest, which = np.unique(edge, return_index=True, return_inverse=True)
            child = waiting[earliest]
            slots.append(taken)
            kids.append(child)
            at[waiting] = child[which]
            waiting = np.delete(waiting, earliest)
        slots, kids = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (slots, kids))
        order = np.argsort(slots)
        self._slots, self._kids = slots[order], kids[order]

    def within(self, queries: np.ndarray, roots: np.ndarray, radius: int):
        """Yields (i, node) arrays: nodes of the tree under roots[i] that are within radius of queries[i]."""
        work = [(np.arange(len(queries)), np.asarray(roots))]
        reach = np.arange(-radius, radius + 1)
        while work:
            q, node = work.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                work += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            if not len(q):
                continue
            d = distances(queries[q], self.codes[node])
            near = d <= radius
            yield q[near], node[near]
            if not len(self._slots):
                continue
            edges = d[:, None] + reach
            wanted = np.where((edges > 0) & (edges < _EDGES), node[:, None] * _EDGES + edges, -1)
            place = np.minimum(np.searchsorted(self._slots, wanted), len(self._slots) - 1)
            there = self._slots[place] == wanted
            work.append((np.broadcast_to(q[:, None], there.shape)[there], self._kids[place[there]]))

    def ties(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(code, representative) of every code that links within radius tie to an earlier one of its group."""
        label = np.arange(len(self.codes))
        for a, b in self.within(self.codes, self.root, radius):
            later = a > b
            a, b = a[later], b[later]
            while True:  # the smaller label spreads along the links until both ends agree
                x, y = label[a], label[b]
                apart = x != y
                if not apart.any():
                    break
                np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
                while (label[label] != label).any():
                    label = label[label]
        while (label[label] != label).any():
            label = label[label]
        tied = np.flatnonzero(label != np.arange(len(label)))
        return self.codes[tied], self.codes[label[tied]]
