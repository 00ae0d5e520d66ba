"""A prefix tree of globally ordered n-gram sets, and the exact Jaccard join of one group by it."""

from __future__ import annotations

import numpy as np

MIXED = -1


class _Node:
    __slots__ = ("edge", "ends", "kids", "label", "largest", "smallest")

    def __init__(self, edge: np.ndarray, size: int, label: int):
        self.edge, self.kids, self.ends = edge, {}, []
        self.smallest = self.largest = size
        self.label = label


class Forest:
    """Union-find over places 0..n-1; the root is the smallest place."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def union(self, a: int, b: int) -> int:
        a, b = self.find(a), self.find(b)
        if a != b:
            a, b = min(a, b), max(a, b)
            self.parent[b] = a
        return a


class PrefixTree:
    """Sets as increasing paths of ranks; shared first parts are stored and intersected once."""

    def __init__(self, n_ranks: int, forest: Forest):
        self.root = _Node(np.zeros(0, np.int32), 0, MIXED)
        self.root.smallest, self.root.largest = 1 << 62, 0
        self.forest = forest
        self.has = np.zeros(n_ranks, bool)

    def insert(self, place: int, ranks: np.ndarray) -> None:
        size, at, node = len(ranks), 0, self.root
        find = self.forest.find
        own = find(place)
        while True:
            node.smallest, node.largest = min(node.smallest, size), max(node.largest, size)
            if node is not self.root and node.label != MIXED and find(node.label) != own:
                node.label = MIXED
            if at == size:
                node.ends.append(place)
                return
            kid = node.kids.get(key := int(ranks[at]))
            if kid is None:
                node.kids[key] = leaf = _Node(ranks[at:], size, own)
                leaf.ends.append(place)
                return
            both = min(len(kid.edge), size - at)
            differ = np.flatnonzero(kid.edge[:both] != ranks[at : at + both])
            same = int(differ[0]) if len(differ) else both
            if same < len(kid.edge):
                upper = _Node(kid.edge[:same], size, kid.label)
                upper.smallest, upper.largest = kid.smallest, kid.largest
                kid.edge = kid.edge[same:]
                upper.kids[int(kid.edge[0])] = kid
                node.kids[key] = kid = upper
            at += same
            node = kid

    def link(self, place: int, ranks: np.ndarray) -> None:
        """Unite ``place`` with every stored set of Jaccard similarity 0.75 or more.

        Subtrees whose sets are all in the same component already are not entered, nor those in
        which not even all remaining ranks in common would reach the overlap that is needed.
        """
        size, find, has = len(ranks), self.forest.find, self.has
        has[ranks] = True
        stack = [(self.root, 0, 0, iter(self.root.kids.values()))]
        while stack:
            node, overlap, depth, kids = stack[-1]
            mine = find(place)
            if node.label != MIXED and find(node.label) == mine:
                stack.pop()
                continue
            for kid in kids:
                if kid.largest * 4 < size * 3 or (kid.label != MIXED and find(kid.label) == mine):
                    continue
                o = overlap + int(np.count_nonzero(has[kid.edge]))
                d = depth + len(kid.edge)
                left = min(size - int(np.searchsorted(ranks, kid.edge[-1], "right")), kid.largest - d)
                if 7 * (o + left) < 3 * (size + kid.smallest):
                    continue
                if kid.ends and 7 * o >= 3 * (size + d):
                    for other in kid.ends:
                        self.forest.union(place, other)
                stack.append((kid, o, d, iter(kid.kids.values())))
                break
            else:
                stack.pop()
        has[ranks] = False


def linked(sets: list[np.ndarray], parts: np.ndarray | None = None) -> np.ndarray:
    """For each of the sets (sorted distinct uint64, none empty) the smallest place it is linked with, also over others.

    Sets with equal ``parts`` are known to be linked.

    The common order of the n-grams is by falling frequency in the group, then by value, so that
    near copies share their first part. Sets are joined in the order of their sizes.
    """
    forest = Forest(len(sets))
    if parts is not None:
        firsts: dict[int, int] = {}
        for place, part in enumerate(parts.tolist()):
            forest.union(firsts.setdefault(part, place), place)
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((values, -counts))
    rank = np.empty(len(values), np.int32)
    rank[order] = np.arange(len(values), dtype=np.int32)
    ends = np.cumsum([len(x) for x in sets])
    ranks = [np.sort(rank[inverse[e - len(x) : e]]) for x, e in zip(sets, ends)]
    tree = PrefixTree(len(values), forest)
    for place in sorted(range(len(sets)), key=lambda i: (len(sets[i]), i)):
        tree.link(place, ranks[place])
        tree.insert(place, ranks[place])
    return np.array([forest.find(i) for i in range(len(sets))])
