"""BK-trees of 64-bit fingerprints: children are keyed by their Hamming distance to the parent.

A forest holds many trees in flat arrays, so that all of them are built, and asked, level by level
together. A search follows an edge only if its distance is within the radius of the distance
between the query and the parent; by the triangle inequality nothing near is behind the others.
"""

from __future__ import annotations

import numpy as np

_KEYS = 65  # distances 0 to 64
_BLOCK = 1 << 14  # queries that are asked at once


class Forest:
    """Trees of distinct fingerprints (uint64), one per value of ``tree`` (0, 1, ...)."""

    def __init__(self, prints: np.ndarray, tree: np.ndarray):
        self.prints = prints
        n = len(prints)
        order = np.argsort(tree, kind="stable")
        first = np.ones(n, bool)
        first[1:] = tree[order][1:] != tree[order][:-1]
        #: the first fingerprint of a tree is its root
        self.roots = order[first]
        left = order[~first]
        below = self.roots[np.cumsum(first) - 1][~first]
        edges, children = [], []
        while len(left):
            key = below * _KEYS + np.bitwise_count(prints[left] ^ prints[below])
            edge, head, number = np.unique(key, return_index=True, return_inverse=True)
            child = left[head]
            edges.append(edge)
            children.append(child)
            deeper = np.ones(len(left), bool)
            deeper[head] = False
            left, below = left[deeper], child[number[deeper]]
        edges = np.concatenate([*edges, np.zeros(0, np.int64)])
        order = np.argsort(edges)
        self.edges = edges[order]
        self.children = np.concatenate([*children, np.zeros(0, np.int64)])[order]

    def near(self, queries: np.ndarray, roots: np.ndarray, radius: int
             ) -> tuple[np.ndarray, np.ndarray]:
        """(number of query, position in ``prints``) within ``radius``; query i asks ``roots[i]``.

        A query that asks several trees is given once for each.
        """
        found = [(np.zeros(0, np.int64),) * 2]
        for k in range(0, len(queries), _BLOCK):
            asks = np.arange(k, min(k + _BLOCK, len(queries)))
            node = roots[asks]
            while len(asks):
                distance = np.bitwise_count(queries[asks] ^ self.prints[node]).astype(np.int64)
                hit = distance <= radius
                found.append((asks[hit], node[hit]))
                at = node * _KEYS
                low = np.searchsorted(self.edges, at + np.maximum(distance - radius, 0))
                high = np.searchsorted(
                    self.edges, at + np.minimum(distance + radius, _KEYS - 1), side="right")
                many = high - low
                within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                node = self.children[np.repeat(low, many) + within]
                asks = np.repeat(asks, many)
        asks, node = zip(*found, strict=True)
        return np.concatenate(asks), np.concatenate(node)


def star_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, least node) with the connected components of the links (a, b); values alike."""
    nodes, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = number[:len(a)], number[len(a):]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[x], label[y])
        after = label.copy()
        np.minimum.at(after, label[x], least)
        np.minimum.at(after, label[y], least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    some = label != np.arange(len(nodes))
    return nodes[some], nodes[label[some]]
