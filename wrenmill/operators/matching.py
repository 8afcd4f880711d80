"""Maximum-weight matching of a general graph, by the primal-dual blossom method, run per connected component.

Vertices carry duals, sets of odd size shrink to blossoms with duals of their own. Each free vertex in turn grows one alternating tree along tight
edges, shrinks odd cycles, expands blossoms whose dual runs out, and ends with an augmenting path to another free vertex, or where the dual of an
even vertex runs out: that one stays free in its stead. A search looks at its own tree and what borders on it, not at the whole component. Weights are
integers of 1e-9 here, so that tightness is exact; edges of no positive weight are never used.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wrenmill.operators.components import components

SCALE = 1_000_000_000


class Blossoms:
    """State of the search: vertices are 1..n, blossoms lie above n, 0 is none."""

    def __init__(self, n: int, edges: list[tuple[int, int, int]]) -> None:
        self.n = n
        self.size = n
        # links[x][y]: the end in x, the end in y and the weight of the tightest edge between two sets
        self.links: dict[int, dict[int, tuple[int, int, int]]] = {x: {} for x in range(1, n + 1)}
        for u, v, w in edges:
            if w > 0 and u != v and w > self.links[u].get(v, (0, 0, 0))[2]:
                self.links[u][v], self.links[v][u] = (u, v, w), (v, u, w)
        # the heaviest edge of each vertex: no edge weighs more than half of the two duals together
        self.dual = {x: max((w for _, _, w in self.links[x].values()), default=0) for x in range(1, n + 1)}
        self.mate = dict.fromkeys(range(1, n + 1), 0)
        self.top = {x: x for x in range(1, n + 1)}
        self.part: dict[int, list[int]] = {}
        self.inner: dict[int, dict[int, int]] = {x: {x: x} for x in range(1, n + 1)}
        self.slack: dict[int, int] = {}
        self.parent: dict[int, int] = {}
        self.label: dict[int, int] = {}
        self.seen: dict[int, int] = {}
        self.tick = 0
        self.queue: deque[int] = deque()

    def reduced(self, e: tuple[int, int, int]) -> int:
        return self.dual[e[0]] + self.dual[e[1]] - 2 * e[2]

    def offer(self, u: int, x: int) -> None:
        old = self.slack.get(x, 0)
        if not old or self.reduced(self.links[u][x]) < self.reduced(self.links[old][x]):
            self.slack[x] = u

    def find_slack(self, x: int) -> None:
        self.slack[x] = 0
        for u in self.links[x]:
            if u <= self.n and self.top[u] != x and self.label.get(self.top[u]) == 0:
                self.offer(u, x)

    def push(self, x: int) -> None:
        if x <= self.n:
            self.queue.append(x)
        else:
            for y in self.part[x]:
                self.push(y)

    def rename(self, x: int, b: int) -> None:
        self.top[x] = b
        if x > self.n:
            for y in self.part[x]:
                self.rename(y, b)

    def turn(self, b: int, x: int) -> int:
        """The even place of x in the cycle of b, reversed if need be."""
        cycle = self.part[b]
        at = cycle.index(x)
        if at % 2:
            cycle[1:] = cycle[:0:-1]
            return len(cycle) - at
        return at

    def marry(self, u: int, v: int) -> None:
        e = self.links[u][v]
        self.mate[u] = e[1]
        if u > self.n:
            x = self.inner[u][e[0]]
            at = self.turn(u, x)
            cycle = self.part[u]
            for i in range(at):
                self.marry(cycle[i], cycle[i ^ 1])
            self.marry(x, v)
            cycle[:] = cycle[at:] + cycle[:at]

    def augment(self, u: int, v: int) -> None:
        while True:
            nxt = self.top.get(self.mate[u], 0) if self.mate[u] else 0
            self.marry(u, v)
            if not nxt:
                return
            up = self.top[self.parent[nxt]]
            self.marry(nxt, up)
            u, v = up, nxt

    def meet(self, u: int, v: int) -> int:
        """The lowest common ancestor of two trees' vertices, 0 for different trees."""
        self.tick += 1
        while u or v:
            if u:
                if self.seen.get(u) == self.tick:
                    return u
                self.seen[u] = self.tick
                u = self.top[self.mate[u]] if self.mate[u] else 0
                if u:
                    u = self.top[self.parent[u]]
            u, v = v, u
        return 0

    def shrink(self, u: int, base: int, v: int) -> None:
        b = next((x for x in range(self.n + 1, self.size + 1) if not self.top.get(x)), self.size + 1)
        self.size = max(self.size, b)
        self.dual[b], self.label[b], self.mate[b] = 0, 0, self.mate[base]
        self.parent[b] = self.parent.get(base, 0)
        cycle = [base]
        for start in (u, v):
            x = start
            while x != base:
                y = self.top[self.mate[x]]
                cycle += [x, y]
                self.push(y)
                x = self.top[self.parent[y]]
            if start == u:
                cycle[1:] = cycle[:0:-1]
        self.part[b] = cycle
        self.rename(b, b)
        self.links[b], self.inner[b] = {}, {}
        for x in cycle:
            for y, e in list(self.links[x].items()):
                if y == b:
                    continue
                old = self.links[b].get(y)
                if old is None or self.reduced(e) < self.reduced(old):
                    self.links[b][y] = e
                    self.links[y][b] = (e[1], e[0], e[2])
            for y in self.inner[x]:
                self.inner[b][y] = x
        self.find_slack(b)

    def expand(self, b: int) -> None:
        for x in self.part[b]:
            self.rename(x, x)
        x = self.inner[b][self.links[b][self.parent[b]][0]]
        at = self.turn(b, x)
        cycle = self.part[b]
        for i in range(0, at, 2):
            odd, even = cycle[i], cycle[i + 1]
            self.parent[odd] = self.links[even][odd][0]
            self.label[odd], self.label[even] = 1, 0
            self.slack[odd] = 0
            self.find_slack(even)
            self.push(even)
        self.label[x], self.parent[x] = 1, self.parent[b]
        for y in cycle[at + 1 :]:
            self.label[y] = -1
            self.find_slack(y)
        self.top[b] = 0
        for y in self.links.pop(b):
            self.links[y].pop(b, None)

    def tight(self, e: tuple[int, int, int]) -> bool:
        """Take a tight edge into the tree; True if it completes an augmenting path."""
        u, v = self.top[e[0]], self.top[e[1]]
        if self.label.get(v, -1) == -1:
            if not self.mate[v]:
                self.augment(u, v)
                self.marry(v, u)
                return True
            self.parent[v], self.label[v] = e[0], 1
            mate = self.top[self.mate[v]]
            self.slack[v] = self.slack[mate] = 0
            self.label[mate] = 0
            self.push(mate)
        elif self.label[v] == 0:
            self.shrink(u, self.meet(u, v), v)
        return False

    def free(self, x: int, u: int) -> None:
        """Leave the vertex u of x without a mate."""
        self.mate[x] = 0
        if x > self.n:
            y = self.inner[x][u]
            at = self.turn(x, y)
            cycle = self.part[x]
            for i in range(at):
                self.marry(cycle[i], cycle[i ^ 1])
            self.free(y, u)
            cycle[:] = cycle[at:] + cycle[:at]

    def exchange(self, u: int) -> None:
        """Turn the path from the root to the even vertex u, which stays free."""
        x = self.top[u]
        odd = self.top[self.mate[x]] if self.mate[x] else 0
        self.free(x, u)
        if odd:
            up = self.top[self.parent[odd]]
            self.marry(odd, up)
            self.augment(up, odd)

    def vertices(self, x: int) -> Iterable[int]:
        return (x,) if x <= self.n else self.inner[x]

    def search(self, root: int) -> None:
        """One tree, from a free vertex whose dual is not yet 0."""
        self.label, self.slack, self.queue = {}, {}, deque()
        x = self.top[root]
        self.parent[x], self.label[x] = 0, 0
        self.push(x)
        while True:
            while self.queue:
                u = self.queue.popleft()
                if self.label.get(self.top[u]) != 0:
                    continue
                for v, e in list(self.links[u].items()):
                    if v > self.n or self.top[u] == self.top[v]:
                        continue
                    if self.reduced(e) == 0:
                        if self.tight(e):
                            return
                    elif u in self.links[self.top[v]]:
                        self.offer(u, self.top[v])
            sides: tuple[list[int], list[int]] = ([], [])
            for x, l in self.label.items():
                if l >= 0 and self.top.get(x) == x:
                    sides[l].append(x)
            step, least = min((self.dual[u], u) for x in sides[0] for u in self.vertices(x))
            for b in sides[1]:
                if b > self.n:
                    step = min(step, self.dual[b] // 2)
            border = [x for x, u in self.slack.items() if u and self.top.get(x) == x and self.label.get(x) != 1]
            for x in border:
                left = self.reduced(self.links[self.slack[x]][x])
                step = min(step, left if self.label.get(x, -1) == -1 else left // 2)
            for change, side in zip((-step, step), sides):
                for x in side:
                    for u in self.vertices(x):
                        self.dual[u] += change
                    if x > self.n:
                        self.dual[x] -= 2 * change
            if not self.dual[least]:
                return self.exchange(least)
            for x in border:
                if self.top.get(x) == x and self.slack.get(x) and self.top[self.slack[x]] != x:
                    e = self.links[self.slack[x]][x]
                    if self.reduced(e) == 0 and self.tight(e):
                        return
            for b in sides[1]:
                if b > self.n and self.top.get(b) == b and self.label.get(b) == 1 and self.dual[b] == 0:
                    self.expand(b)


def heaviest(edges: list[tuple[str, str, float]]) -> list[tuple[str, str]]:
    """The pairs (a < b) of a maximum-weight matching."""
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    place = {x: i + 1 for i, x in enumerate(names)}
    # even weights keep every dual step whole
    state = Blossoms(len(names), [(place[a], place[b], 2 * round(w * SCALE)) for a, b, w in sorted(edges)])
    for x in range(1, len(names) + 1):
        if not state.mate[x] and state.dual[x]:
            state.search(x)
    return [(names[u - 1], names[v - 1]) for u, v in state.mate.items() if u <= state.n and v and u < v]


def maximum_weight_matching(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """(a, b) of the matched pairs, a < b: each component of the edges by itself, so no value is in two pairs."""
    rows = edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.max(weight).alias("w"))
    parts = components(rows, "a", "b")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(heaviest(list(pdf[["a", "b", "w"]].itertuples(index=False, name=None))), columns=["a", "b"])

    kind = rows.schema["a"].dataType.simpleString()
    return rows.join(parts.withColumnRenamed("node", "a"), "a").groupBy("component").applyInPandas(run, f"a {kind}, b {kind}")
