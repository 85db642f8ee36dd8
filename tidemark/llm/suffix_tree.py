"""Suffix trees of integer sequences, with constant-time lowest common ancestors.

``SuffixTree`` is built by Ukkonen's algorithm from left to right. A tour of the tree lists its leaves in the
order of their suffixes; the depth that the tour falls to between two leaves is the length of
the longest common prefix of their suffixes, and a sparse table of these minima answers any pair in constant time.
"""

from __future__ import annotations

from array import array

import numpy as np


class SuffixTree:
    """Tree of ``values`` (non-negative integers) behind which an end that differs from all of them is put."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.text = (np.asarray(values, np.int64) + 1).tolist() + [0]
        self.width = max(self.text) + 1
        self._build()
        self._shape()
        order, turns = self._tour()
        self.rank = self._ranks(order)
        #: Minima of ``turns`` over stretches of 1, 2, 4 ... of them.
        self.minima = [turns]
        while (step := 1 << (len(self.minima) - 1)) * 2 <= len(turns):
            below = self.minima[-1]
            self.minima.append(np.minimum(below[: len(below) - step], below[step:]))

    def _build(self) -> None:
        """Ukkonen: after step i the tree holds all suffixes of the first i values, the last ones implicitly."""
        text, width, n = self.text, self.width, len(self.text)
        start, end, link = array("q", [0]), array("q", [0]), array("q", [0])
        child: dict[int, int] = {}
        node = edge = length = waiting = 0
        for i, c in enumerate(text):
            waiting += 1
            unlinked = 0
            while waiting:
                if not length:
                    edge = i
                key = node * width + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    span = (i + 1 if end[below] > i else end[below]) - start[below]
                    if length >= span:
                        edge, length, node = edge + span, length - span, below
                        continue
                    if text[start[below] + length] == c:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    split = len(start)
                    start.append(start[below])
                    end.append(start[below] + length)
                    link.append(0)
                    child[key] = split
                    start[below] += length
                    child[split * width + text[start[below]]] = below
                    child[split * width + c] = split + 1
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if unlinked:
                        link[unlinked] = split
                    unlinked = split
                waiting -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - waiting + 1
        self.start, self.end, self.child = np.frombuffer(start, np.int64), np.frombuffer(end, np.int64), child

    def _shape(self) -> None:
        """Parents, depths and edges in the order of (parent, first value)."""
        m, n = len(self.start), len(self.text)
        keys = np.fromiter(self.child.keys(), np.int64, len(self.child))
        to = np.fromiter(self.child.values(), np.int64, len(self.child))
        self.child = {}
        by = np.argsort(keys)
        keys, self.to = keys[by], to[by]
        self.first = np.searchsorted(keys, np.arange(m + 1) * self.width)
        up, depth = np.zeros(m, np.int64), self.end - self.start
        up[self.to] = keys // self.width
        while up.any():  # each round doubles how far a node has looked up
            depth = depth + depth[up]
            up = up[up]
        self.depth = depth
        self.leaf = self.end == n
        self.leaf[0] = False
        self.suffix = n - depth  # where a leaf's suffix starts

    def _tour(self, falling: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in the order of the tour, and the depth of the lowest common ancestor of each leaf and the next:
        that of the node from which the tour goes on. With ``falling`` greater values come first, the end still before them."""
        to, first, leaf, depth, suffix = (x.tolist() for x in (self.to, self.first, self.leaf, self.depth, self.suffix))
        is_end = (self.start == self.n).tolist()
        order, turns, waits, turn = array("q"), array("i"), [(0, 0)], 0
        while waits:
            v, above = waits.pop()
            turn = min(turn, above)
            here = depth[v]
            if leaf[v]:
                order.append(suffix[v])
                turns.append(turn)
                turn = here
                continue
            below = to[first[v] : first[v + 1]]
            if not falling:
                below.reverse()
            elif is_end[below[0]]:
                below.append(below.pop(0))
            waits += [(w, here) for w in below]
        return np.frombuffer(order, np.int64), np.frombuffer(turns, np.int32)[1:]

    def _ranks(self, order: np.ndarray) -> np.ndarray:
        rank = np.empty(self.n + 1, np.int64)
        rank[order] = np.arange(self.n + 1)
        return rank

    def falling_rank(self) -> np.ndarray:
        """Ranks of the suffixes where greater values come first; a prefix still comes before what it starts."""
        return self._ranks(self._tour(True)[0])

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and ``b``, pair by pair."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        out = self.n - np.asarray(a, np.int64)  # of a suffix with itself
        apart = np.flatnonzero(low < high)
        low, size = low[apart], (high - low)[apart]
        level = np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            row = self.minima[k]
            out[apart[at]] = np.minimum(row[low[at]], row[low[at] + size[at] - (1 << k)])
        return out
