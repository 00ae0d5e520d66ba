"""Exact one-to-one assignment of vectors in one task, without a matrix of all pairs.

Shortest augmenting paths with duals ``u`` and ``v``. A row knows its ``LISTED`` least costs and a bound that no other one is
below, each less the columns' duals. As these only fall, bounds stay true: a search goes over lists, and looks at all columns of
a row only once its bound is the least of what is open.

Where sides are about as large as each other, prices of an auction over the same lists come first, and rows begin with their
column of least cost at these prices. Prices don't decide the result, only how far searches go: it is a best assignment whatever they are.
"""

from __future__ import annotations

import heapq
import math

import numpy as np

from simloom.operators.auction import bids

LISTED, BLOCK_VALUES, FROM_ROWS = 64, 1 << 22, 2048
#: Increments of the auction, as parts of the spread of listed costs; sides that differ by more than ``ALIKE`` go without.
INCREMENTS, ALIKE = (0.1, 0.02, 0.004, 0.001), 1.2


class _Lists:
    """The least costs of each row of ``few`` on those of ``many``; a cost is a product with its sign changed."""

    def __init__(self, few: np.ndarray, many: np.ndarray, listed: int):
        self.few, self.many, self.listed = few, many, min(listed, len(many))
        self.columns = np.empty((len(few), self.listed), np.int64)
        self.costs, self.bound = np.empty((len(few), self.listed)), np.empty(len(few))
        # like rows should list unlike columns where costs are the same, but for their last bits
        self.slack = 1e-14 * few.shape[1] * np.abs(few).max() * np.abs(many).max()
        self.noise = np.random.default_rng(1).random(2 * len(many)) * self.slack

    def renew(self, rows: np.ndarray, v: np.ndarray) -> None:
        step = max(1, BLOCK_VALUES // len(v))
        for k in range(0, len(rows), step):
            part = rows[k : k + step]
            costs = -(self.few[part] @ self.many.T)
            self._keep(part, costs, costs - v)

    def whole(self, row: int, v: np.ndarray) -> np.ndarray:
        """The costs of one row on all columns, less ``v``; its list is renewed."""
        costs = -(self.many @ self.few[row])
        reduced = costs - v
        self._keep(np.array([row]), costs[None], reduced[None])
        return reduced

    def _keep(self, rows: np.ndarray, costs: np.ndarray, reduced: np.ndarray) -> None:
        m = costs.shape[1]
        if m == self.listed:
            self.columns[rows], self.costs[rows], self.bound[rows] = np.arange(m), costs, math.inf
            return
        apart = np.empty_like(reduced)
        for k, first in enumerate((rows * 7919 % m).tolist()):
            np.add(reduced[k], self.noise[first : first + m], out=apart[k])
        at = np.argpartition(apart, self.listed, axis=1)[:, : self.listed]
        self.columns[rows], self.costs[rows] = at, np.take_along_axis(costs, at, 1)
        np.copyto(apart, reduced)
        np.put_along_axis(apart, at, math.inf, 1)
        self.bound[rows] = apart.min(axis=1)

    def best(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's column of least cost less ``v``, and that cost."""
        own = np.arange(len(self.few))
        reduced = self.costs - v[self.columns]
        at = reduced.argmin(axis=1)
        short = np.flatnonzero(reduced[own, at] > self.bound)
        self.renew(short, v)
        reduced[short] = self.costs[short] - v[self.columns[short]]
        at = reduced.argmin(axis=1)
        return self.columns[own, at], np.minimum(reduced[own, at], self.bound)


def _priced(lists: _Lists, m: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Prices and holders of the columns by an auction; None where costs are hardly apart."""
    spread = float(lists.costs.max() - lists.costs.min())
    if not spread > 1e-6 * np.abs(lists.costs).max():
        return None
    price = np.zeros(m)
    for part in INCREMENTS:
        holder, stuck = np.full(m, -1), None
        while stuck is None or len(stuck):
            stuck = np.flatnonzero(bids(lists.columns, -lists.costs, -lists.bound - lists.slack, price, holder, part * spread))
            lists.renew(stuck, -price)
    return price, holder


def assigned(few: np.ndarray, many: np.ndarray, listed: int = LISTED) -> np.ndarray:
    """The row of ``many`` for each row of ``few``, of largest total product; values must be finite, ``few`` not longer."""
    n, m = len(few), len(many)
    if n > m:
        raise ValueError("more rows than columns")
    if not n:
        return np.empty(0, np.int64)
    lists = _Lists(few, many, listed)
    u, v, row_of, column_of = np.zeros(n), np.zeros(m), np.full(m, -1), np.full(n, -1)
    lists.renew(np.arange(n), v)
    priced = _priced(lists, m) if m <= ALIKE * n else None
    if priced:
        price, holder = priced
        if n < m:  # columns that stay free must be the cheapest
            price = np.maximum(price, price[holder < 0].max())
        v = -price
        best, u = lists.best(v)
        row_of[best] = np.arange(n)
        held = np.flatnonzero(holder >= 0)
        held = held[best[holder[held]] == held]
        row_of[held] = holder[held]
        held = np.flatnonzero(row_of >= 0)
        column_of[row_of[held]] = held
    search = _Search(lists, u, v, row_of, column_of)
    for row in np.flatnonzero(column_of < 0).tolist():
        search.augment(row)
    if priced:
        search.free_cheapest()
    return column_of


class _Search:
    """Augmenting paths; ``row_of`` is -1 for a free column, and the number of rows for one that has to stay free."""

    def __init__(self, lists: _Lists, u: np.ndarray, v: np.ndarray, row_of: np.ndarray, column_of: np.ndarray):
        self.lists, self.u, self.v, self.row_of, self.column_of = lists, u, v, row_of, column_of
        self.least, self.way, self.closed = np.empty(len(v)), np.empty(len(v), np.int64), np.empty(len(v), bool)

    def free_cheapest(self) -> None:
        """The columns that stay free become the cheapest, as if rows to which all columns are alike had to have one each."""
        while True:
            top = self.v.max()
            free = np.flatnonzero(self.row_of < 0)
            cheap = self.v[free] >= top - 1e-13 * (1 + abs(top))
            self.row_of[free[cheap]] = len(self.u)
            if cheap.all():
                return
            self.augment(len(self.u))

    def augment(self, first: int) -> None:
        lists, u, v, row_of, least, way, closed, n = self.lists, self.u, self.v, self.row_of, self.least, self.way, self.closed, len(self.u)
        least.fill(math.inf)
        closed.fill(False)
        i, low, columns, reached, heap = first, 0.0, [], [], []
        if first == n:
            np.subtract(v.max(), v, out=least)
            way.fill(n)
        while True:
            if i < n:
                own = lists.columns[i]
                reduced = lists.costs[i] - v[own]
                reduced += low - u[i]
                use = (reduced < least[own]) & ~closed[own]
                own = own[use]
                least[own], way[own] = reduced[use], i
                heapq.heappush(heap, (lists.bound[i] + (low - u[i]), i, low))
            while True:
                j = int(least.argmin())
                if not heap or heap[0][0] >= least[j]:
                    break
                _, k, at = heapq.heappop(heap)
                reduced = lists.whole(k, v)
                reduced += at - u[k]
                use = (reduced < least) & ~closed
                np.copyto(least, reduced, where=use)
                np.copyto(way, k, where=use)
            if row_of[j] >= 0 and least[j] == low:  # of ties a free column ends the search
                same = np.flatnonzero(least == low)
                same = same[row_of[same] < 0]
                j = int(same[0]) if len(same) else j
            low = float(least[j])
            if row_of[j] < 0:
                break
            columns.append(j)
            reached.append(low)
            least[j], closed[j] = math.inf, True
            i = int(row_of[j])
        rows, less = row_of[columns], low - np.array(reached)
        real = rows < n
        u[rows[real]] += less[real]
        v[columns] -= less
        if first < n:
            u[first] += low
        while True:
            i = int(way[j])
            row_of[j] = i
            if i == n:
                break
            self.column_of[i], j = j, int(self.column_of[i])
            if i == first:
                break
