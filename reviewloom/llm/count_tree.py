"""An R-tree over vectors of group counts, the join of its points by a bound on shared tokens, and the links that connect sets."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np

GROUPS = 128          # groups of the tree's points
MOST_GROUPS = 1 << 14  # groups of the finest points
FANOUT = 16
ROWS = 4096  # pairs of nodes bounded at once


def group_counts(tokens: np.ndarray) -> np.ndarray:
    """How many of the hashed tokens fall in each group. Groups are told apart by leading bits, about one to a token: GROUPS at
    least, twice as many for sets twice as large."""
    bits = min(max(7, int(len(tokens)).bit_length()), MOST_GROUPS.bit_length() - 1)
    return np.bincount((tokens >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint16)


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The same counts in fewer groups: neighbours are added up."""
    return counts.reshape(groups, -1).sum(axis=1, dtype=np.int64)


def coarse_counts(tokens: np.ndarray) -> np.ndarray:
    """`group_counts` in an eighth of the groups, GROUPS at least: what a tree needs to tell unrelated sets apart."""
    counts = group_counts(tokens)
    return folded(counts, max(GROUPS, len(counts) // 8)).astype(np.uint16)


def packed(counts: np.ndarray) -> bytes:
    """Counts as they travel: most are small, so they shrink to a fraction."""
    return zlib.compress(counts.astype("<u2").tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), "<u2")


def shared_bound(a: np.ndarray, b: np.ndarray) -> int:
    """Two sets share at most the sum of the smaller counts of each group, in the finest groups that both have."""
    groups = min(len(a), len(b))
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum())


def needed(sizes_a: np.ndarray, sizes_b: np.ndarray, percent: int) -> np.ndarray:
    """The least number of shared tokens with 100 * shared >= percent * union."""
    return -(-percent * (sizes_a.astype(np.int64) + sizes_b) // (100 + percent))


def may_match(a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether rows of points can be similar enough: two sets share at most the sum of the smaller counts of each group."""
    shared = np.minimum(a, b).sum(axis=1, dtype=np.int64)
    return shared >= needed(sizes_a, sizes_b, percent)


class CountTree:
    """Points packed by size and then by their leading coordinates, FANOUT to a node; a node keeps the largest count
    of each group and the smallest size below it, so the same bound holds for everything in it."""

    def __init__(self, points: list[np.ndarray], sizes: np.ndarray):
        counts = np.stack([folded(p, GROUPS) for p in points]) if points else np.empty((0, GROUPS), np.int64)
        slabs = max(1, int(np.sqrt(len(sizes) / FANOUT)))
        by_size = np.argsort(sizes, kind="stable")
        slab = np.empty(len(sizes), np.int64)
        slab[by_size] = np.arange(len(sizes)) * slabs // max(1, len(sizes))
        lead = np.argsort(-counts.var(axis=0), kind="stable")[:3] if len(sizes) else []
        self.order = np.lexsort([*(counts[:, g] for g in reversed(lead)), slab])
        self.levels = [(counts[self.order], sizes[self.order].astype(np.int64), sizes[self.order].astype(np.int64))]
        while len(self.levels[-1][1]) > 1:
            top, low, high = self.levels[-1]
            cuts = np.arange(0, len(low), FANOUT)
            self.levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts)))

    def candidates(self, percent: int, labels: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Indices (i, j) of all pairs of points with different labels that can be similar, some thousands at a time, by descending
        from the pair (root, root): a pair of nodes that fails the bound, or that holds one label only, is left with all below it."""
        if len(self.order) < 2:
            return
        smallest = [labels[self.order]]
        largest = [smallest[0]]
        for _, low, _ in self.levels[:-1]:
            cuts = np.arange(0, len(low), FANOUT)
            smallest.append(np.minimum.reduceat(smallest[-1], cuts))
            largest.append(np.maximum.reduceat(largest[-1], cuts))
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            if len(a) > ROWS:
                stack += [(level, a[at: at + ROWS], b[at: at + ROWS]) for at in range(0, len(a), ROWS)]
                continue
            top, low, high = self.levels[level]
            keep = (100 * high[a] >= percent * low[b]) & (100 * high[b] >= percent * low[a])
            down, up = smallest[level], largest[level]
            keep &= (down[a] != up[a]) | (down[b] != up[b]) | (down[a] != down[b])
            if not level:
                keep &= a < b
            a, b = a[keep], b[keep]
            keep = may_match(top[a], top[b], low[a], low[b], percent)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if not level:
                yield self.order[a], self.order[b]
                continue
            below = len(self.levels[level - 1][1])
            steps = np.arange(FANOUT)
            i = np.repeat(a[:, None] * FANOUT + steps, FANOUT, axis=1).ravel()
            j = np.tile(b[:, None] * FANOUT + steps, (1, FANOUT)).ravel()
            inside = (i < below) & (j < below) & (i <= j)
            stack.append((level - 1, i[inside], j[inside]))


def shared_tokens(a: np.ndarray, b: np.ndarray) -> int:
    """How many tokens two sorted sets share."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


class Parts:
    """Which of some numbers links connect."""

    def __init__(self, labels: np.ndarray):
        _, first, group = np.unique(labels, return_index=True, return_inverse=True)
        self.parent = first[group]

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = int(self.parent[i])
        return i

    def apart(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Which of many pairs nothing connects yet."""
        while not np.array_equal(above := self.parent[self.parent], self.parent):
            self.parent = above
        return self.parent[one] != self.parent[two]

    def link(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.parent[max(a, b)] = min(a, b)

    def star(self) -> list[tuple[int, int]]:
        """Every number that is not the smallest of its part, and that smallest one."""
        return [(i, r) for i in range(len(self.parent)) if (r := self.root(i)) != i]


def spanning(points: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Each point that may be similar to one with a different label, with the first point that such pairs connect it to. Pairs are
    bounded in all the groups they have, unless others connect them already."""
    parts = Parts(np.arange(len(sizes)))
    for one, two in CountTree(points, sizes).candidates(percent, labels):
        apart = parts.apart(one, two)
        least = needed(sizes[one[apart]], sizes[two[apart]], percent).tolist()
        for i, j, n in zip(one[apart].tolist(), two[apart].tolist(), least):
            if parts.root(i) != parts.root(j) and shared_bound(points[i], points[j]) >= n:
                parts.link(i, j)
    return parts.star()


def forest(sets: list[np.ndarray], settled: np.ndarray, labels: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Each set that is joined to another, by its label or by similarity, with the first set it is joined to over any number of steps.

    Candidates come from a tree over the sets' counts; pairs with one value of `settled` are none. Those that are joined
    already are passed over; the others are verified on the sets themselves.
    """
    parts = Parts(labels)
    sizes = np.array([len(s) for s in sets], np.int64)
    for one, two in CountTree([group_counts(s) for s in sets], sizes).candidates(percent, settled):
        apart = parts.apart(one, two)
        for i, j in zip(one[apart].tolist(), two[apart].tolist()):
            if parts.root(i) != parts.root(j):
                shared = shared_tokens(sets[i], sets[j])
                if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                    parts.link(i, j)
    return parts.star()
