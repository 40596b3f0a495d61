"""Search of many ordered sets at once in a prefix tree of ordered sets.

The tree is held as ranges: its paths lie in lexicographic order, and a node is
a range of paths with the tokens that all of them have next (runs without a
branching are one node).  A node is visited once for all queries that are still
alive there: their overlap with its tokens is read off the queries' own index
and serves every path below.  Nothing recurses.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

LAST = np.int32(2**31 - 1)
MOST_WAITING = 1 << 18  # doubtful pairs that a search keeps before it drops those tied meanwhile


def required(n: np.ndarray | int, m: np.ndarray | int, threshold: int) -> np.ndarray | int:
    """Common tokens that sets of n and m need: 100 i >= threshold (n + m - i)."""
    return -(-threshold * (n + m) // (100 + threshold))


class Forest:
    """Labels of sets; equal labels are one component."""

    def __init__(self, label: np.ndarray):
        self.label = np.unique(label, return_inverse=True)[1].ravel()

    def tie(self, one: int, others: np.ndarray) -> np.ndarray:
        """Unite a set with others; which of them were new to its component, one of each component."""
        own, first = np.unique(self.label[others], return_index=True)
        fresh = own != self.label[one]
        if fresh.any():
            self.label[np.isin(self.label, own)] = self.label[one]
        return others[first[fresh]]


def neighbours(paths: list[np.ndarray], order: list[int]) -> np.ndarray:
    """Length of the beginning that each path has in common with the one before in order; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for k in range(1, len(order)):
        a, b = paths[order[k - 1]], paths[order[k]]
        short = min(len(a), len(b))
        differ = a[:short] != b[:short]
        at = int(differ.argmax()) if short else 0
        out[k] = at if short and differ[at] else short
    return out


def _apart(pairs: list[tuple[np.ndarray, ...]], components: Forest) -> tuple[np.ndarray, ...]:
    """The pairs (query, set, room) whose components are still different, for any two components the one with the most room."""
    near, one, left = map(np.concatenate, zip(*pairs, strict=True))
    x, y = components.label[near], components.label[one]
    other = np.flatnonzero(x != y)
    other = other[np.argsort(-left[other], kind="stable")]
    first = np.unique(np.minimum(x, y)[other] * len(components.label) + np.maximum(x, y)[other], return_index=True)[1]
    return near[other[first]], one[other[first]], left[other[first]]


def search(paths: list[np.ndarray], sizes: np.ndarray, label: np.ndarray, asks: np.ndarray, held: np.ndarray, threshold: int, forest: bool, room: Callable[[np.ndarray, int], tuple[np.ndarray, np.ndarray]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, set) of different components that may link.

    ``paths`` are the beginnings of globally ordered sets of ``sizes`` tokens; the
    sets that ``held`` marks make the tree, those that ``asks`` marks are the
    queries.  A pair is left out only if its overlap can't reach what a link
    needs: sets of unequal size, or too few common tokens in what was read to
    make it up in what remains of the shorter side.  A subtree that lies in the
    query's own component is left.  At a path's end, ``room`` can tell by a bound of
    its own how far each query left is from being ruled out (below 0: it is), and
    whether a link is as good as sure.  With ``forest``, pairs count as links, the
    sure ones at once and the others at the end, nearest first, and only those that
    unite components are returned.
    """
    none = np.zeros(0, np.int64)
    ids = np.flatnonzero(held)
    queries = np.flatnonzero(asks)
    if not len(ids) or not len(queries):
        return none, none
    raw = [paths[i].astype(">i4").tobytes() for i in ids]
    order = ids[sorted(range(len(ids)), key=raw.__getitem__)]
    common = neighbours(paths, order.tolist())
    length = np.array([len(paths[i]) for i in order])
    own = sizes[order]
    # The queries' tokens, each with the queries that hold it.
    count = np.array([len(paths[q]) for q in queries])
    token = np.concatenate([paths[q] for q in queries])
    by = np.argsort(token, kind="stable")
    token, holder = token[by], np.repeat(np.arange(len(queries)), count)[by]
    n = sizes[queries]
    # Beyond its own beginning a query's tokens aren't known, and may be any.
    last = np.array([LAST if len(paths[q]) == s else (paths[q][-1] if len(paths[q]) else -1) for q, s in zip(queries, n, strict=True)])
    components = Forest(label)
    a, b = [], []
    doubtful, waiting = [], 0
    stack = [(0, len(order), 0, np.arange(len(queries)), np.zeros(len(queries), np.int64))]
    while stack:
        lo, hi, depth, alive, overlap = stack.pop()
        below = components.label[order[lo:hi]]
        least, most = own[lo:hi].min(), own[lo:hi].max()
        good = (100 * most >= threshold * n[alive]) & (100 * n[alive] >= threshold * least)
        if (below == below[0]).all():
            good &= components.label[queries[alive]] != below[0]
        alive, overlap = alive[good], overlap[good]
        if not len(alive):
            continue
        end = int(common[lo + 1 : hi].min()) if hi - lo > 1 else int(length[lo])
        run = paths[order[lo]][depth:end]
        if len(run):
            x, y = np.searchsorted(token, run, "left"), np.searchsorted(token, run, "right")
            met = y - x
            at = np.arange(met.sum()) - np.repeat(np.cumsum(met) - met, met) + np.repeat(x, met)
            overlap = overlap + np.bincount(holder[at], minlength=len(queries))[alive] + len(run) - np.searchsorted(run, last[alive], "right")
        good = np.minimum(overlap + most - end, n[alive]) >= required(n[alive], least, threshold)
        alive, overlap = alive[good], overlap[good]
        if not len(alive):
            continue
        ends = lo
        while ends < hi and length[ends] == end:
            one, m = int(order[ends]), int(own[ends])
            fits = (100 * m >= threshold * n[alive]) & (100 * n[alive] >= threshold * m) & (overlap + m - end >= required(n[alive], m, threshold))
            near = queries[alive[fits]]
            near = near[components.label[near] != components.label[one]]
            if room is not None and len(near):
                left, sure = room(near, one)
                if forest and (later := (left >= 0) & ~sure).any():
                    doubtful.append((near[later], np.full(later.sum(), one), left[later]))
                    waiting += int(later.sum())
                near = near[sure if forest else left >= 0]
            if len(near):
                if forest:
                    near = components.tie(one, near)
                a.append(near)
                b.append(np.full(len(near), one))
            ends += 1
        if waiting > MOST_WAITING:
            doubtful, waiting = [_apart(doubtful, components)], 0
        cuts = [ends, *(np.flatnonzero(common[ends + 1 : hi] == end) + ends + 1).tolist(), hi] if ends < hi else []
        stack += [(i, j, end, alive, overlap) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    if doubtful:
        near, one, left = _apart(doubtful, components)
        for k in np.argsort(-left, kind="stable").tolist():
            if components.label[one[k]] != components.label[near[k]]:
                components.tie(int(one[k]), near[k : k + 1])
                a.append(near[k : k + 1])
                b.append(one[k : k + 1])
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)
