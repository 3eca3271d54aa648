"""BK-trees over 64-bit fingerprints, as numpy arrays that hold a forest of them.

Children of a node are keyed by their Hamming distance to it. A search within a radius r follows,
from a node at distance d, only edges d-r to d+r; by the triangle inequality no other leads to a hit.
All trees of a forest are built, and all queries answered, level by level in array operations.
"""

from __future__ import annotations

import numpy as np

_EDGE = 128  # above any distance, so that node * _EDGE + distance orders edges by node, then distance


class Forest:
    """One tree per run of equal `shard` values (which must be adjacent); values of a shard differ."""

    def __init__(self, shard: np.ndarray, value: np.ndarray):
        n = len(value)
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, np.int64)
        self.value = value
        self.size = np.diff(np.r_[first, n])
        self.root = np.repeat(first, self.size)
        self.tree_size = np.repeat(self.size, self.size)
        parents, edges, nodes = [], [], []
        left = np.flatnonzero(self.root != np.arange(n))
        at = self.root[left]
        while len(left):
            code = at * _EDGE + np.bitwise_count(value[left] ^ value[at])
            kinds, place, which = np.unique(code, return_index=True, return_inverse=True)
            child = left[place]  # the first row of each (node, distance) becomes that child
            parents.append(kinds // _EDGE), edges.append(kinds % _EDGE), nodes.append(child)
            at = child[which]
            down = at != left
            left, at = left[down], at[down]
        node = np.concatenate([*nodes, np.zeros(0, np.int64)]).astype(np.int64)
        code = np.concatenate([*(p * _EDGE + e for p, e in zip(parents, edges, strict=True)), np.zeros(0, np.int64)]).astype(np.int64)
        order = np.argsort(code)
        self.code, self.child = code[order], node[order]

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, hit) of positions in one tree at most `radius` apart, the query itself left out."""
        found_q, found_n = [], []
        q, node = queries, self.root[queries]
        while len(q):
            d = np.bitwise_count(self.value[q] ^ self.value[node]).astype(np.int64)
            hit = (d <= radius) & (q != node)
            found_q.append(q[hit]), found_n.append(node[hit])
            lo = np.searchsorted(self.code, node * _EDGE + np.maximum(d - radius, 0))
            hi = np.searchsorted(self.code, node * _EDGE + d + radius, "right")
            many = hi - lo
            q = np.repeat(q, many)
            node = self.child[np.repeat(lo - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(len(q))]
        return np.concatenate([*found_q, np.zeros(0, np.int64)]), np.concatenate([*found_n, np.zeros(0, np.int64)])

    def linked(self, radius: int, work: int = 1 << 21) -> np.ndarray:
        """For each position, the first one of its tree that it reaches by links of at most `radius`.

        Queries are answered in blocks whose trees have `work` nodes in sum, and each block's links
        are merged before the next, so pairs never pile up.
        """
        n = len(self.value)
        to = np.arange(n)
        start, cost = 0, np.cumsum(self.tree_size)
        while start < n:
            end = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + work, "right")))
            q, node = self.within(np.arange(start, end), radius)
            while len(q):
                a, b = to[q], to[node]
                open_ = a != b
                q, node, a, b = q[open_], node[open_], a[open_], b[open_]
                if not len(q):
                    break
                np.minimum.at(to, np.maximum(a, b), np.minimum(a, b))
                while not np.array_equal(up := to[to], to):
                    to = up
            start = end
        return to
