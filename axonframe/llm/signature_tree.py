"""Signature trees: OR-combined bitmaps and size ranges over sorted runs of sets.

A leaf is a set with its size and a bitmap of its elements.  An inner node holds the OR of its
leaves' bitmaps, their smallest and largest size, and the largest surplus (elements that share
a bit with another element of the same set).  For leaves a and b under nodes A and B

    |a & b| <= popcount(A & B) + min(surplus A, surplus B),

because every common element sets a bit that both nodes have, and a set has no more elements
than bits plus surplus.  Two nodes whose bound is too low for the wanted similarity, or whose
size ranges are too far apart, are dropped with all pairs below them.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Leaves of a lowest node, and nodes of the next level.
LEAVES = 64
FAN = 8


def bitmap_bits(size: int) -> int:
    """Bits of the bitmap of a set: a power of two, at least twice its size."""
    return max(256, 1 << (2 * size - 1).bit_length())


def bitmap(values: np.ndarray) -> bytes:
    """The bitmap of a set of 64-bit hashes."""
    bits = bitmap_bits(len(values))
    flags = np.zeros(bits, np.uint8)
    flags[(values & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def folded(maps: list[bytes]) -> np.ndarray:
    """Bitmaps as equal rows of 64-bit words.  Longer ones are folded by OR, which keeps the bound."""
    width = min(map(len, maps))
    rows = np.empty((len(maps), width // 8), np.uint64)
    for i, raw in enumerate(maps):
        row = np.frombuffer(raw, np.uint64)
        rows[i] = row if len(raw) == width else np.bitwise_or.reduce(row.reshape(-1, width // 8), axis=0)
    return rows


class Level:
    """Nodes of one level: bitmaps, size ranges, surplus, and the range of leaves below each."""

    def __init__(self, bits, low, high, surplus, start):
        self.bits, self.low, self.high, self.surplus, self.start = bits, low, high, surplus, start

    def above(self, fan: int) -> Level:
        at = np.arange(0, len(self.low), fan)
        return Level(
            np.bitwise_or.reduceat(self.bits, at, axis=0), np.minimum.reduceat(self.low, at),
            np.maximum.reduceat(self.high, at), np.maximum.reduceat(self.surplus, at), np.append(self.start[:-1][at], self.start[-1]),
        )

    def possible(self, rows: np.ndarray, columns: np.ndarray, percent: int, limit: int) -> np.ndarray:
        """Which of rows x columns may hold a pair with 100 * common >= percent * united.

        One set of the pair must not be larger than ``limit``.
        """
        low_a, low_b = self.low[rows][:, None], self.low[columns][None, :]
        high_a, high_b = self.high[rows][:, None], self.high[columns][None, :]
        near = (100 * high_b >= percent * low_a) & (100 * high_a >= percent * low_b) & (np.minimum(low_a, low_b) <= limit)
        i, j = np.nonzero(near)
        if not len(i):
            return near
        common = np.empty(len(i), np.int64)
        step = max(1, (1 << 21) // self.bits.shape[1])  # pairs at a time: 16 MB of words
        for at in range(0, len(i), step):
            a, b = rows[i[at : at + step]], columns[j[at : at + step]]
            common[at : at + step] = np.bitwise_count(self.bits[a] & self.bits[b]).sum(axis=1, dtype=np.int64)
        a, b = rows[i], columns[j]
        bound = np.minimum(common + np.minimum(self.surplus[a], self.surplus[b]), np.minimum(self.high[a], self.high[b]))
        near[i, j] = (100 + percent) * bound >= percent * (self.low[a] + self.low[b])
        return near


class Forest:
    """Which leaves are united (union-find over positions)."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def unite(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.parent[max(i, j)] = min(i, j)

    def roots(self, start: int, stop: int) -> np.ndarray:
        return np.array([self.find(i) for i in range(start, stop)])


def united(
    sizes: np.ndarray, maps: list[bytes], percent: int, forest: Forest, accept: Callable[[int, int], bool] | None = None
) -> None:
    """Unite in ``forest`` all pairs of sets that may be (or, with ``accept``, are) similar enough.

    ``sizes`` ascend, ``percent`` is over 50.  Similar sets have bitmaps of equal or neighbouring
    widths, so there is a tree for each width and the next, and no bitmap is folded more than
    once.  ``accept`` decides on pairs of leaves that pass the bound and are not united yet.
    """
    sizes = np.asarray(sizes, np.int64)
    widths = np.array([len(m) for m in maps])
    for width in np.unique(widths).tolist():
        at = np.flatnonzero((widths == width) | (widths == 2 * width))
        if len(at) > 1:
            limit = int(sizes[widths == width].max())
            _united_tree(at, sizes[at], folded([maps[i] for i in at]), percent, limit, forest, accept)


def _united_tree(at, sizes, bits, percent, limit, forest, accept) -> None:
    """One tree over the sets at positions ``at``.

    Pairs of nodes are visited from the root down; a pair is left when its bound is too low or
    when all leaves below are united already.
    """
    surplus = sizes - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
    levels = [Level(bits, sizes, sizes, surplus, np.arange(len(sizes) + 1))]
    levels.append(levels[0].above(LEAVES))
    while len(levels[-1].low) > 1:
        levels.append(levels[-1].above(FAN))
    places = at.tolist()

    def children(depth: int, node: int) -> np.ndarray:
        fan = LEAVES if depth == 1 else FAN
        return np.arange(node * fan, min((node + 1) * fan, len(levels[depth - 1].low)))

    def one(depth: int, a: int, b: int) -> bool:
        """Whether all leaves below two nodes are united."""
        start = levels[depth].start
        root = forest.find(places[start[a]])
        return all(forest.find(places[i]) == root for node in {a, b} for i in range(start[node], start[node + 1]))

    def visit(depth: int, a: int, b: int) -> None:
        if one(depth, a, b):
            return
        rows, columns = children(depth, a), children(depth, b)
        pairs = levels[depth - 1].possible(rows, columns, percent, limit)
        if a == b:
            pairs &= np.triu(np.ones_like(pairs), k=1 if depth == 1 else 0)
        for i, j in zip(*(x.tolist() for x in np.nonzero(pairs))):
            if depth > 1:
                visit(depth - 1, int(rows[i]), int(columns[j]))
            else:
                i, j = places[rows[i]], places[columns[j]]
                if forest.find(i) != forest.find(j) and (accept is None or accept(i, j)):
                    forest.unite(i, j)

    visit(len(levels) - 1, 0, 0)
