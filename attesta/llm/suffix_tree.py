"""Suffix trees over word sequences, built as a sorted suffix array with exact common prefix lengths."""

from __future__ import annotations

import numpy as np


def ranks(values: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of the first 1, 2, 4, ... values from each place up to the end of its row, until longer sequences tell no more places apart.

    A sequence that its row cuts short comes before longer ones that begin with it.
    """
    n = len(values)
    found, rank = np.unique(values, return_inverse=True)
    levels, count, step, at = [rank], len(found), 1, np.arange(n)
    while count < n:
        after = np.zeros(n, np.int64)
        inside = np.flatnonzero(at + step < ends)
        after[inside] = rank[inside + step] + 1
        found, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        if len(found) == count:
            break
        levels.append(rank)
        count, step = len(found), 2 * step
    return levels


def common_prefixes(levels: list[np.ndarray], ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many values the different suffixes at a and b have in common."""
    length = np.zeros(len(a), np.int64)
    last = len(ends) - 1
    for k in range(len(levels) - 1, -1, -1):
        x, y = a + length, b + length
        same = (x < ends[a]) & (y < ends[b]) & (levels[k][np.minimum(x, last)] == levels[k][np.minimum(y, last)])
        length += same.astype(np.int64) << k
    return length


class Nodes:
    """The nodes of depth ``floor`` or more of a suffix tree, made from sorted leaves.

    Leaf i has length depth[i] and common[i] values in common with leaf i - 1.  Of each node are known its depth, its
    parent (-1 above ``floor``), and over the leaves below it the least owner and the least and largest value before.
    """

    def __init__(self, depth: np.ndarray, common: np.ndarray, owner: np.ndarray, before: np.ndarray, behind: np.ndarray, floor: int) -> None:
        self.depth, self.owner = depth.tolist(), owner.tolist()
        self.before, self.behind = before.tolist(), behind.tolist()
        self.parent = [-1] * len(self.depth)
        path: list[int] = []  # from the root to the latest leaf
        for leaf, shared in enumerate(common.tolist()):
            self._climb(path, shared, floor)
            path.append(leaf)
        self._climb(path, 0, floor)

    def _climb(self, path: list[int], shared: int, floor: int) -> None:
        """Leave the nodes deeper than ``shared``; each tells its parent what is below it."""
        depth = self.depth
        while path and depth[path[-1]] > shared:
            node = path.pop()
            if path and depth[path[-1]] >= shared:
                up = path[-1]
                self.owner[up] = min(self.owner[up], self.owner[node])
                self.before[up] = min(self.before[up], self.before[node])
                self.behind[up] = max(self.behind[up], self.behind[node])
            elif shared >= floor:
                up = len(depth)
                for column in (depth, self.owner, self.before, self.behind, self.parent):
                    column.append(column[node])
                depth[up], self.parent[up] = shared, -1
                path.append(up)
            else:
                continue
            self.parent[node] = up

    def deepest_of_others(self) -> np.ndarray:
        """For each node, the deepest node above it that has a lesser owner, or -1."""
        found = [-1] * len(self.depth)
        for node in np.argsort(self.depth, kind="stable").tolist():
            up = self.parent[node]
            if up >= 0:
                found[node] = up if self.owner[up] < self.owner[node] else found[up]
        return np.array(found, np.int64)


def earlier_repeats(values: np.ndarray, edges: np.ndarray, owner: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal repeats of ``floor`` or more values that a lesser owner has too: where they stand, and their lengths.

    Row r holds values[edges[r]:edges[r + 1]] and belongs to owner[r].  A repeat is reported at a place of an owner if
    its node is the deepest above that place with a lesser owner, and is left-maximal: not all of its places follow one
    and the same value.  (If they do, the place before has a repeat that is longer by one and covers this one.)
    Places come in ascending order.
    """
    ends = np.repeat(edges[1:], np.diff(edges))
    row = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    at = np.flatnonzero(np.arange(len(values)) + floor <= ends)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none
    levels = ranks(values, ends)
    at = at[np.argsort(levels[-1][at], kind="stable")]
    rank = levels[-1][at]
    first = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))  # equal suffixes are one leaf
    heads = at[first]
    common = np.zeros(len(first), np.int64)
    common[1:] = common_prefixes(levels, ends, heads[:-1], heads[1:])
    before = np.where(at > edges[row[at]], levels[0][at - 1], -1 - at)
    deep = common >= floor
    several = np.diff(np.append(first, len(at))) > 1
    leaves = np.flatnonzero(deep | np.append(deep[1:], False) | several)
    if not len(leaves):
        return none, none
    nodes = Nodes(
        (ends - np.arange(len(ends)))[heads[leaves]],
        common[leaves],
        np.minimum.reduceat(owner[row[at]], first)[leaves],
        np.minimum.reduceat(before, first)[leaves],
        np.maximum.reduceat(before, first)[leaves],
        floor,
    )
    leaf = np.full(len(first), -1)
    leaf[leaves] = np.arange(len(leaves))
    leaf = np.repeat(leaf, np.diff(np.append(first, len(at))))
    held = np.flatnonzero(leaf >= 0)
    at, leaf = at[held], leaf[held]
    own = np.array(nodes.owner)
    node = np.where(own[leaf] < owner[row[at]], leaf, nodes.deepest_of_others()[leaf])
    good = (node >= 0) & (np.array(nodes.before) != np.array(nodes.behind))[node]
    order = np.flatnonzero(good)[np.argsort(at[good], kind="stable")]
    return at[order], np.array(nodes.depth)[node[order]]
