"""Counts of word windows in hash containers below a shallow trie of word ids.

A window is four word ids, zeros after the end of its piece, as two 64-bit halves. The trie's
leaves are containers, each for a range of first words, or of second words below one first
word. A container takes windows as they come and sums equal ones by hash; one that grows too
large bursts in two. Beyond its limit the trie spills whole subtrees, the largest first, as runs
sorted by window, so memory stays bounded whatever comes.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from cohortlens.llm.runs import group_sums

#: Distinct windows a container holds before it bursts, and a trie before it spills.
BURST, LIMIT = 1 << 17, 1 << 21

LOW = np.uint64(32)


def halves(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (a row of four ids each) as two 64-bit numbers that sort as they do."""
    w = words.astype(np.uint64)
    return (w[:, 0] << LOW) | w[:, 1], (w[:, 2] << LOW) | w[:, 3]


class Container:
    """Windows of one range of prefixes: arrays as they came, or one array of sums."""

    def __init__(self, tables: list[pa.Table] | None = None):
        self.tables = tables or []
        self.size = sum(t.num_rows for t in self.tables)
        self.whole = 0  # rows when equal windows were last summed

    def add(self, table: pa.Table) -> None:
        self.tables.append(table)
        self.size += table.num_rows

    def sums(self) -> pa.Table:
        table = pa.concat_tables(self.tables)
        if len(self.tables) > 1 or not self.whole:
            table = group_sums(table, ["hi", "lo"], "n")
        self.tables, self.size, self.whole = [table], table.num_rows, table.num_rows
        return table


class HatTrie:
    def __init__(self, burst: int = BURST, limit: int = LIMIT):
        self.burst, self.limit = burst, limit
        self.bounds: list[int] = [0]  # the smallest first half of each leaf
        self.leaves: list[Container] = [Container()]
        self.size = 0

    def add(self, hi: np.ndarray, lo: np.ndarray) -> None:
        """Count windows, each once."""
        order = np.argsort(hi, kind="stable")
        hi, lo = hi[order], lo[order]
        cuts = np.searchsorted(hi, np.array(self.bounds[1:], np.uint64)).tolist()
        table = pa.table({"hi": hi, "lo": lo, "n": np.ones(len(hi), np.int64)})
        for leaf, a, b in list(zip(self.leaves, [0, *cuts], [*cuts, len(hi)], strict=True)):
            if b > a:
                leaf.add(table.slice(a, b - a))
                self.size += b - a
                if leaf.size > max(self.burst, 2 * leaf.whole):
                    self.size -= leaf.size
                    leaf.sums()
                    self.size += leaf.size
                    if leaf.size > self.burst // 2:
                        self._burst(leaf)

    def _burst(self, leaf: Container) -> None:
        """Two containers in place of one, cut between first words, or else between second ones."""
        hi = np.sort(leaf.tables[0].column("hi").to_numpy())
        middle = hi[len(hi) // 2]
        at = (middle >> LOW) << LOW
        if at <= hi[0]:
            at = middle
        if at <= hi[0]:
            return  # one pair of words: nothing above it to cut between
        table = leaf.tables[0]
        right = pa.array(table.column("hi").to_numpy() >= at)
        i = self.leaves.index(leaf)
        parts = [Container([table.filter(pa.compute.invert(right))]), Container([table.filter(right)])]
        for p in parts:
            p.whole = p.size
        self.leaves[i : i + 1] = parts
        self.bounds.insert(bisect_right(self.bounds, int(at)), int(at))

    def spill(self, left: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Whole subtrees, the largest first, until ``left`` windows stay: one sorted run
        ``(hi, lo, n)`` of what goes."""
        gone: list[pa.Table] = []
        for leaf in sorted(self.leaves, key=lambda x: -x.size):
            if self.size <= left or not leaf.size:
                break
            self.size -= leaf.size
            gone.append(leaf.sums())
            leaf.tables, leaf.size, leaf.whole = [], 0, 0
        if gone:
            table = pa.concat_tables(gone)
            hi, lo, n = (table.column(c).to_numpy() for c in ("hi", "lo", "n"))
            order = np.lexsort([lo, hi])
            yield hi[order], lo[order], n[order]

    def full(self) -> bool:
        return self.size > self.limit


# Runs as bytes --------------------------------------------------------------------------


def packed(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> bytes:
    """A sorted run with its bytes by place, where most are alike, compressed."""
    small = np.minimum(n, 255).astype(np.uint8)
    large = n[n >= 255].astype("<i8")
    first, second = np.diff(hi >> LOW, prepend=np.uint64(0)), hi & np.uint64(0xFFFFFFFF)
    columns = [c.astype("<u4") for c in (first, second, lo >> LOW, lo & np.uint64(0xFFFFFFFF))]
    raw = b"".join(c.view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns) + small.tobytes() + large.tobytes()
    head = np.array([len(n), len(raw)], "<u4").tobytes()
    return head + pa.compress(raw, "zstd", asbytes=True)


def unpacked(run: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size, length = np.frombuffer(run, "<u4", 2).astype(int).tolist()
    raw = pa.decompress(run[8:], length, "zstd", asbytes=True)
    planes = np.frombuffer(raw, np.uint8, 16 * size).reshape(4, 4, size)
    columns = [np.ascontiguousarray(p.T).view("<u4").ravel().astype(np.uint64) for p in planes]
    n = np.frombuffer(raw, np.uint8, size, 16 * size).astype(np.int64)
    n[n == 255] = np.frombuffer(raw, "<i8", -1, 17 * size) if len(raw) > 17 * size else 0
    return (np.cumsum(columns[0], dtype=np.uint64) << LOW) | columns[1], (columns[2] << LOW) | columns[3], n


def merged(runs: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One sorted run of several, equal windows summed."""
    parts = [unpacked(r) for r in runs]
    hi, lo, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort([lo, hi])
    hi, lo, n = hi[order], lo[order], n[order]
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    at = np.flatnonzero(new)
    return hi[at], lo[at], np.add.reduceat(n, at)
