"""Least costs over a graph in arrays: ``Flat`` runs any searches side by side, ``Sweep`` one wave for near starts.

Both relax until no arc gives less, so their costs are exact; ``offs``, ``far`` and ``cost`` hold the arcs out of each
node in the order of nodes.
"""

from __future__ import annotations

import math

import numpy as np


def expand(offs: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the arcs of ``nodes``, and for each the number of its node among them."""
    n = offs[nodes + 1] - offs[nodes]
    rep = np.repeat(np.arange(len(nodes)), n)
    return np.arange(len(rep)) + np.repeat(offs[nodes] - (np.cumsum(n) - n), n), rep


def mean(cost: np.ndarray) -> float:
    held = cost[np.isfinite(cost)]
    return (float(held.mean()) if len(held) else 0.0) or 1.0


def small(x: np.ndarray) -> np.ndarray:
    return x.astype(np.int32)


class Flat:
    """Independent searches: states are (search, node), the nearest within ``step`` are relaxed together."""

    def __init__(self, offs: np.ndarray, far: np.ndarray, cost: np.ndarray, wide: int = 1):
        self.offs, self.far, self.cost, self.n = offs, far, cost, len(offs) - 1
        self.step = 2 * mean(cost)
        self.least = np.full(wide * self.n, np.inf)
        self.mark = np.zeros(wide * self.n, np.int32)
        self.touched: list[np.ndarray] = []

    def clear(self) -> None:
        for x in self.touched:
            self.least[x] = np.inf
        self.touched = []

    def _once(self, states: np.ndarray) -> np.ndarray:
        order = np.arange(len(states), dtype=np.int32)
        self.mark[states] = order
        return states[self.mark[states] == order]

    def run(self, starts: np.ndarray, limit: float | np.ndarray = math.inf, enough=None, ahead: np.ndarray | None = None) -> None:
        """Fills ``least`` up to ``limit``, which may be one for each state; ``enough(settled)`` may end it, all states cheaper than ``settled`` being final.

        ``ahead`` is what each state has before it at least, by which states then come in turn: it falls along an arc
        by no more than the arc costs, and costs with it are what ``settled`` bounds.
        """
        self.clear()
        near = np.arange(len(starts)) * self.n + starts
        self.least[near] = 0.0
        self.touched.append(near)
        upto, later = self.step, []
        while True:
            while len(near):
                node = near % self.n
                k, rep = expand(self.offs, node)
                states, total = (near - node)[rep] + self.far[k], self.least[near][rep] + self.cost[k]
                better = (total < self.least[states]) & (total <= (limit[states] if isinstance(limit, np.ndarray) else limit))
                states, total = states[better], total[better]
                self.touched.append(states[np.isinf(self.least[states])])
                np.minimum.at(self.least, states, total)
                states = self._once(states)
                soon = (self.least[states] if ahead is None else self.least[states] + ahead[states]) < upto
                near = states[soon]
                later.append(states[~soon])
            if enough is not None and enough(upto):
                return
            left = self._once(np.concatenate(later))
            total = self.least[left] if ahead is None else self.least[left] + ahead[left]
            left, total = left[total >= upto], total[total >= upto]
            if not len(left):
                return
            upto = max(upto, float(total.min())) + self.step
            near, later = left[total < upto], [left[total >= upto]]

    def reached(self, upto: float = math.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(search, node, cost) of all states that have a cost of at most ``upto``."""
        states = self._once(np.concatenate(self.touched))
        cost = self.least[states]
        states, cost = states[cost <= upto], cost[cost <= upto]
        return states // self.n, states % self.n, cost


class Sweep:
    """Searches from near starts together, a row of costs for each node.

    Nodes are taken up in rings around a centre, whose costs are known. A ring pulls from itself and the rings within,
    then every arc that leads back is tried and what got better goes on until nothing does; so after each ring the
    costs are exact over it and all within.
    """

    def __init__(self, offs: np.ndarray, far: np.ndarray, cost: np.ndarray, around: np.ndarray, rows: np.ndarray):
        n = self.n = len(offs) - 1
        self.around = around
        known = np.isfinite(around)
        most = float(around[known].max()) if known.any() else 0.0
        self.step = max(RING * mean(cost), most / 20_000)
        ring = np.where(known, np.floor(np.where(known, around, 0) / self.step) + 1, 0).astype(np.int64)
        src = np.repeat(np.arange(n), np.diff(offs))
        on, back = ring[src] <= ring[far], ring[src] >= ring[far]
        degree = np.bincount(far[on], minlength=n)
        top = int(degree.max(initial=0)) + 1
        self.order = np.argsort((ring * top + (top - 1 - degree)) * n + np.arange(n))
        self.pos = np.empty(n, np.int64)
        self.pos[self.order] = np.arange(n)
        self.rings = ring[self.order]
        self.last = int(self.rings[-1]) if n else 0
        self.first = np.searchsorted(self.rings, np.arange(self.last + 2))
        # arcs on, by ring and by their number at their end
        fs, fd, fc = self.pos[src[on]], self.pos[far[on]], cost[on]
        o = np.argsort(fd, kind="stable")
        fs, fd, fc = fs[o], fd[o], fc[o]
        held = degree[self.order]
        rank = np.arange(len(fd)) - (np.cumsum(held) - held)[fd]
        key = self.rings[fd] * top + rank
        o = np.argsort(key * n + fd)
        self.fs, self.fc, key = small(fs[o]), fc[o], key[o]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)
        self.slots: list[list[tuple[int, int]]] = [[] for _ in range(self.last + 1)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            self.slots[int(key[a]) // top].append((a, b))
        # arcs back, by the ring they leave
        bs, bd, bc = self.pos[src[back]], self.pos[far[back]], cost[back]
        o = np.argsort(bs * n + bd)
        self.bs, self.bd, self.bc = small(bs[o]), small(bd[o]), bc[o]
        self.back = np.searchsorted(self.bs, self.first)
        k, _ = expand(offs, self.order)
        self.offs = np.concatenate([[0], np.cumsum(np.diff(offs)[self.order])])
        self.far, self.cost = small(self.pos[far[k]]), cost[k]
        self.least = rows

    def _assign(self, end: np.ndarray, total: np.ndarray) -> np.ndarray:
        changed, first = np.unique(end, return_index=True)
        at = changed
        while True:
            self.now[at] = np.minimum(self.now[at], total[first])
            if len(at) == len(end):
                return changed
            rest = np.ones(len(end), bool)
            rest[first] = False
            end, total = end[rest], total[rest]
            at, first = np.unique(end, return_index=True)

    def _relax(self, nodes: np.ndarray, below: int) -> None:
        least = self.now
        while len(nodes):
            k, rep = expand(self.offs, nodes)
            end = self.far[k]
            inside = end < below
            k, rep, end = k[inside], rep[inside], end[inside]
            total = least[nodes[rep]] + self.cost[k][:, None]
            better = np.flatnonzero((total < least[end]).any(axis=1))
            if not len(better):
                return
            nodes = self._assign(end[better], total[better])

    def run(self, starts: np.ndarray, limit: float = math.inf, goals: list[np.ndarray] | None = None) -> np.ndarray:
        """[place of a node, start]: least costs; those of nodes beyond ``limit``, or beyond all of each start's goals, may be too high."""
        least, at = self.least[:, : len(starts)], self.pos[starts]
        if len(starts) < self.least.shape[1]:
            least = np.ascontiguousarray(least)
        self.now = least
        least.fill(np.inf)
        least[at, np.arange(len(at))] = 0.0
        begin = self.around[starts]
        ring = int(self.rings[at].max(initial=0))
        self._relax(np.unique(at), int(self.first[ring + 1]))
        while ring < self.last:
            if (limit < math.inf or goals is not None) and ring % 8 == 0 and self._ended(ring * self.step - begin, limit, goals):
                break
            ring += 1
            a, b = int(self.first[ring]), int(self.first[ring + 1])
            if a == b:
                continue
            own = least[a:b]
            for x, y in self.slots[ring]:
                total = np.take(least, self.fs[x:y], axis=0)
                total += self.fc[x:y, None]
                np.minimum(own[: y - x], total, out=own[: y - x])
            x, y = int(self.back[ring]), int(self.back[ring + 1])
            if x < y:
                total = np.take(least, self.bs[x:y], axis=0)
                total += self.bc[x:y, None]
                better = np.flatnonzero((total < np.take(least, self.bd[x:y], axis=0)).any(axis=1))
                if len(better):
                    self._relax(self._assign(self.bd[x:y][better], total[better]), b)
        return least

    def _ended(self, sure: np.ndarray, limit: float, goals: list[np.ndarray] | None) -> bool:
        """Whether no node of a ring to come can matter; ``sure`` is the least that such a node costs from each start."""
        if np.isnan(sure).any() or not np.isfinite(sure).all():
            return False
        if (sure > limit).all():
            return True
        return goals is not None and all((self.now[self.pos[g], j] < sure[j]).all() for j, g in enumerate(goals) if len(g))


RING = 0.5  #: width of a ring in mean costs of arcs
