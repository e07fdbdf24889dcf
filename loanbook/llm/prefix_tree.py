"""Path-compressed prefix tree of ordered key sets, searched level by level.

Sets that begin alike share tree nodes, so the overlap of a probe with a
shared path is counted once. A subtree is left as soon as its overlap so far
and the shorter of the two remainders can't reach what its smallest set needs.
All live nodes of a level are handled by a few array operations.
"""

from __future__ import annotations

import numpy as np

#: keys of one tree node; a longer path is a chain, so that it can be left midway
SEGMENT = 64


class PrefixTree:
    """``sets``: ascending unsigned 64-bit keys without repeats, none empty."""

    def __init__(self, sets: list[np.ndarray]):
        same: dict[bytes, list[int]] = {}
        for i, s in enumerate(sets):
            same.setdefault(s.astype(">u8").tobytes(), []).append(i)
        self.members = [same[raw] for raw in sorted(same)]  # equal sets are stored once
        sets = [sets[m[0]] for m in self.members]
        size = [len(s) for s in sets]
        at = (np.cumsum(size) - size).tolist()
        self.keys = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        common = [_shared(a, b) for a, b in zip(sets[:-1], sets[1:], strict=True)]
        # breadth first, so that the children of a node stand together
        rows, level = [], [(0, len(sets) - 1, 0, -1)] if sets else []
        todo = self._split(level, size, common)
        self.roots = len(todo)
        begin = 0
        while begin < len(todo):
            first, last, depth, end, _ = todo[begin]
            ends_here = first if size[first] == end else -1
            inner = [(first + (ends_here >= 0), last, end, begin)] if first + (ends_here >= 0) <= last else []
            if end < min(size[first:last + 1]) and (first == last or end < min(common[first:last])):
                children = [(first, last, end, self._end(first, last, end, size, common), begin)]  # a chain goes on
            else:
                children = self._split(inner, size, common)
            rows.append((at[first] + depth, end - depth, depth, end, min(size[first:last + 1]), max(size[first:last + 1]),
                         ends_here, len(todo), len(children)))
            todo += children
            begin += 1
        table = np.array(rows, np.int64).reshape(-1, 9).T
        (self.start, self.length, self.depth, self.end, self.low, self.high, self.stored, self.child, self.children) = table

    @staticmethod
    def _end(first, last, depth, size, common):
        end = size[first] if first == last else min(common[first:last])
        return min(end, depth + SEGMENT)

    def _split(self, ranges, size, common):
        out = []
        for first, last, depth, parent in ranges:
            a = first
            for i in range(first, last + 1):
                if i == last or common[i] <= depth:
                    out.append((a, i, depth, self._end(a, i, depth, size, common), parent))
                    a = i + 1
        return out

    def search(self, probe: np.ndarray, percent: int) -> list[int]:
        """Indices of the sets whose Jaccard similarity with ``probe`` is
        ``percent`` hundredths or more."""
        n, found = len(probe), []

        def enough(overlap, size):
            return overlap * (100 + percent) >= percent * (n + size)

        node = np.arange(self.roots)
        overlap, passed = np.zeros(len(node), np.int64), np.zeros(len(node), np.int64)
        while len(node):
            live = enough(overlap + np.minimum(self.high[node] - self.depth[node], n - passed), self.low[node])
            node, overlap = node[live], overlap[live]
            if not len(node):
                break
            length = self.length[node]
            first = np.cumsum(length) - length
            place = np.repeat(self.start[node] - first, length) + np.arange(int(length.sum()))
            keys = self.keys[place]
            at = np.searchsorted(probe, keys)
            hit = probe[np.minimum(at, n - 1)] == keys
            overlap = overlap + np.add.reduceat(hit.astype(np.int64), first)
            last = first + length - 1
            passed = at[last] + hit[last]
            whole = (self.stored[node] >= 0) & enough(overlap, self.end[node])
            found.append(self.stored[node][whole])
            count = self.children[node]
            step = np.cumsum(count) - count
            child = np.repeat(self.child[node] - step, count) + np.arange(int(count.sum()))
            node, overlap, passed = child, np.repeat(overlap, count), np.repeat(passed, count)
        return [i for k in (np.concatenate(found).tolist() if found else []) for i in self.members[k]]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    m = min(len(a), len(b))
    differ = a[:m] != b[:m]
    return int(differ.argmax()) if differ.any() else m


def block_links(nodes: list[int], roots: list[int], sides: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links between the probes (side 1 or 2) and the stored sets (side 0 or
    2) of different roots. Sets of one root stand in a tree of their own,
    which the probes of that root skip; lone roots share one tree."""
    by_root: dict[int, list[int]] = {}
    for i, side in enumerate(sides):
        if side != 1:
            by_root.setdefault(roots[i], []).append(i)
    lone = [g[0] for g in by_root.values() if len(g) == 1]
    trees = [(None, lone, PrefixTree([sets[i] for i in lone]))] if lone else []
    trees += [(r, g, PrefixTree([sets[i] for i in g])) for r, g in by_root.items() if len(g) > 1]
    out = []
    for i, side in enumerate(sides):
        if side == 0:
            continue
        for root, members, tree in trees:
            if root != roots[i]:
                out += [(nodes[i], nodes[members[k]]) for k in tree.search(sets[i], percent) if members[k] != i]
    return [(a, b) for a, b in out if a != b]
