"""Plain versions of what the operators compute, for small inputs."""

import re
from collections import Counter

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def bag(text, size=5):
    w = words(text)
    if not w:
        return Counter()
    if len(w) < size:
        return Counter([tuple(w)])
    return Counter(tuple(w[i:i + size]) for i in range(len(w) - size + 1))


def weighted_jaccard(a, b):
    if not a or not b:
        return 0.0
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def groups_of(n, links):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    return [root(x) for x in range(n)]
