"""A trie over documents' term vectors, and branch-and-bound in it for the documents that suit an item best."""

from __future__ import annotations

import numpy as np

#: Documents of a leaf: a run of sorted vectors is not split further.
LEAF = 64


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What one unit of a term's weight adds to a score; grows with ``tf`` and falls with ``m``."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class DocumentTree:
    """Documents by their vectors (rank of the term, tf), terms in order of their frequency.

    Sorted by their vectors, documents that begin with the same terms lie together, so each node of the trie is a run of
    documents. A node keeps for each term below it the largest tf, and the smallest m of its documents; a score below
    it is at most what a document with those would have. Nodes that would hold a few documents each are one leaf.
    """

    def __init__(self, starts: np.ndarray, ranks: np.ndarray, tf: np.ndarray, m: np.ndarray) -> None:
        """Document i has the entries ``starts[i]:starts[i + 1]``, at least one, of ascending ranks."""
        keys, offsets = ranks.astype(">u4").tobytes(), (4 * starts).tolist()
        keys = [keys[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        #: The documents in the tree's order, as places in the arrays given.
        self.order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        sizes = np.diff(starts)[self.order]
        self._starts = np.concatenate([[0], np.cumsum(sizes)])
        entry = np.repeat(starts[:-1][self.order] - self._starts[:-1], sizes) + np.arange(self._starts[-1])
        self._ranks, self._m = ranks[entry], m[self.order]
        tf = tf[entry]
        self._impact = impact(tf, np.repeat(self._m, sizes))
        self._grow(sizes)
        self._summarize(tf)

    def _shared(self, sizes: np.ndarray) -> np.ndarray:
        """How many first terms each document shares with the one before it."""
        place = np.arange(self._starts[-1]) - np.repeat(self._starts[:-1], sizes)
        before = np.repeat(np.concatenate([[0], sizes[:-1]]), sizes)
        begins = np.repeat(np.concatenate([[0], self._starts[:-2]]), sizes)
        same = (place < before) & (self._ranks[np.where(place < before, begins + place, 0)] == self._ranks)
        return np.minimum.reduceat(np.where(same, np.repeat(sizes, sizes), place), self._starts[:-1]) if len(sizes) else sizes

    def _grow(self, sizes: np.ndarray) -> None:
        shared = self._shared(sizes)
        self._from, self._to, self._parent, self._level, self._children = [0], [len(sizes)], [-1], [0], {}
        todo = [0]
        while todo:
            node = todo.pop()
            a, b = self._from[node], self._to[node]
            if b - a <= LEAF:
                continue
            inner = shared[a + 1:b]
            cuts = [a, *(a + 1 + np.flatnonzero(inner == inner.min())).tolist(), b]
            runs, first = [], a
            for at, end in zip(cuts[1:], [*cuts[2:], None], strict=True):
                # Neighbouring branches of a few documents are bundled up to the size of a leaf.
                if end is None or end - first > LEAF:
                    runs.append((first, at))
                    first = at
            self._children[node] = list(range(len(self._from), len(self._from) + len(runs)))
            for x, y in runs:
                self._from.append(x)
                self._to.append(y)
                self._parent.append(node)
                self._level.append(self._level[node] + 1)
            todo += self._children[node]

    def _summarize(self, tf: np.ndarray) -> None:
        """For each term the nodes it lies below and its largest tf there."""
        width = int(self._ranks.max()) + 1 if len(self._ranks) else 1
        leaves = sorted((n for n in range(len(self._from)) if n not in self._children), key=self._from.__getitem__)
        pools: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n in leaves:
            a, b = self._starts[self._from[n]], self._starts[self._to[n]]
            pools.setdefault(self._level[n], []).append((n * width + self._ranks[a:b], tf[a:b]))
        parent = np.array(self._parent)
        found = []
        for level in range(max(pools), -1, -1):
            key, value = (np.concatenate(x) for x in zip(*pools.pop(level), strict=True))
            order = np.argsort(key, kind="stable")
            key, value = key[order], value[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
            key, value = key[first], np.maximum.reduceat(value, first) if len(first) else value
            found.append((key, value))
            if level:
                pools.setdefault(level - 1, []).append((parent[key // width] * width + key % width, value))
        key, value = (np.concatenate(x) for x in zip(*found, strict=True))
        node, rank = key // width, key % width
        least = np.array([self._m[a:b].min() if b > a else 1 for a, b in zip(self._from, self._to, strict=True)])
        order = np.argsort(rank, kind="stable")
        self._node, self._bound = node[order], impact(value, least[node])[order]
        self._of_rank = np.searchsorted(rank[order], np.arange(width + 1))
        self._width = width

    def best(self, ranks: np.ndarray, weights: np.ndarray, k: int, floor: int, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``order``, scores) of the ``k`` highest scores from ``floor`` on, 1 at least; equal ones by ``ids``.

        ``ids`` are the ranks of the documents' ids, by the tree's order. Branches are entered by falling bounds and left when no score
        below them can reach the ``k``-th found.
        """
        inside = ranks < self._width
        ranks, weights = ranks[inside], weights[inside]
        a, n = self._of_rank[ranks], np.diff(self._of_rank)[ranks]
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
        bound = np.zeros(len(self._from), np.int64)
        np.add.at(bound, self._node[at], np.repeat(weights, n) * self._bound[at])
        weight = np.zeros(self._width, np.int64)
        weight[ranks] = weights
        floor = max(floor, 1)
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        todo = [0] if len(self.order) else []
        while todo:
            node = todo.pop()
            if bound[node] < floor:
                continue
            if node in self._children:
                kids = self._children[node]
                todo += [kids[i] for i in np.argsort(bound[kids], kind="stable").tolist() if bound[kids[i]] >= floor]
                continue
            a, b = self._from[node], self._to[node]
            x, y = self._starts[a], self._starts[b]
            got = np.add.reduceat(weight[self._ranks[x:y]] * self._impact[x:y], self._starts[a:b] - x)
            new = np.flatnonzero(got >= floor)
            if len(new):
                places, scores = np.concatenate([places, a + new]), np.concatenate([scores, got[new]])
                if len(places) >= k:
                    keep = np.lexsort((ids[places], -scores))[:k]
                    places, scores = places[keep], scores[keep]
                    floor = max(floor, int(scores[-1]))
        return places, scores
