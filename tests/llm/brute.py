"""Plain Python versions of what the operators compute, for small tables."""

from __future__ import annotations

import math
import re
from collections import Counter

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(n, linked):
    """Smallest member of each member's component, for indices below n."""
    parent = list(range(n))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        low, high = sorted((top(a), top(b)))
        parent[high] = low
    return [top(i) for i in range(n)]


def near_components(texts, percent=85):
    sets = [shingles(t) for t in texts]
    linked = [
        (a, b) for b in range(len(sets)) for a in range(b)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return [len(s) for s in sets], groups(len(sets), linked)


def windows(text, size=10):
    w = ITEM_WORD.findall((text or "").translate(LOWER))
    if not w:
        return []
    size = min(size, len(w))
    return [tuple(w[i : i + size]) for i in range(len(w) - size + 1)]


def contaminated(text, items):
    """Number of words, hit word numbers and found items of one text."""
    w = ITEM_WORD.findall((text or "").translate(LOWER))
    hit, found = set(), set()
    for item, item_text in items:
        for window in windows(item_text):
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit.update(range(i, i + len(window)))
                    found.add(item)
    return len(w), hit, found


def discounts(counts):
    k = [sum(1 for c in counts if c == i) for i in (1, 2, 3, 4)]
    if not all(k):
        return 0.5, 1.0, 1.5
    y = k[0] / (k[0] + 2 * k[1])
    raw = (1 - 2 * y * k[1] / k[0], 2 - 3 * y * k[2] / k[1], 3 - 4 * y * k[3] / k[2])
    return tuple(min(max(d, 0.1), i) for i, d in enumerate(raw, 1))


class Bigrams:
    """The model by its definition."""

    def __init__(self, texts):
        rows = [words(t) + ["</s>"] for t in texts]
        self.counts = Counter(w for r in rows for w in r)
        self.pairs = Counter(p for r in rows for p in zip(["<s>", *r], r, strict=False))
        self.total, self.types = sum(self.counts.values()), len(self.counts)
        self.by, before = discounts(self.pairs.values()), Counter(w for _, w in self.pairs)
        self.low = discounts(before.values())
        self.before, self.kinds = before, max(1, sum(before.values()))
        left = sum(self.cut(c, self.low) for c in before.values())
        self.rest = left / self.kinds if before else 1.0
        self.seen, self.spread = Counter(), Counter()
        for (u, _), c in self.pairs.items():
            self.seen[u] += c
            self.spread[u] += self.cut(c, self.by)

    @staticmethod
    def cut(count, by):
        return by[min(count, 3) - 1] if count else 0.0

    def word(self, w):
        c = self.before[w]
        return (c - self.cut(c, self.low)) / self.kinds + self.rest / (self.types + 1)

    def pair(self, u, w):
        if not self.seen[u]:
            return self.word(w)
        c = self.pairs[u, w]
        return (c - self.cut(c, self.by) + self.spread[u] * self.word(w)) / self.seen[u]

    def score(self, text):
        r = words(text) + ["</s>"]
        base = sum(math.log10((self.counts[w] + 1) / (self.total + self.types + 1)) for w in r)
        own = sum(math.log10(self.pair(u, w)) for u, w in zip(["<s>", *r], r, strict=False))
        return len(r), sum(self.counts[w] > 0 for w in r), base, own
