"""Merging of one large component in a task: flat arrays, with adjacency made for nodes that merge only.

Edges are kept as arrays, about 40 bytes each; a node gets a dict of its edges when it first
takes part in a merge, and ``Graph.freeze`` turns all of them back into arrays, so what is
held as Python objects stays bounded.  Nodes are places in the order of their ids, so ties
are the same by place as by id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

HELD = 3_000_000  # entries of dicts before they are turned back into arrays


def columns(batches: Iterable[pa.RecordBatch], kinds: dict) -> list[np.ndarray]:
    """Columns of a group as arrays of their own, while its batches are let go.

    Arrays grow in place: a list of small pieces would be held beside what is put together of it.
    """
    n, held = 0, {c: np.empty(1 << 12, kind) for c, kind in kinds.items()}
    for batch in batches:
        end = n + batch.num_rows
        for c, own in held.items():
            if end > len(own):
                own.resize(max(end, 2 * len(own)), refcheck=False)
            own[n:end] = batch.column(c).to_numpy(zero_copy_only=False)
        n = end
    for own in held.values():
        own.resize(n, refcheck=False)
    return list(held.values())


def coded(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All ids in order, and the places of the lesser and the greater end of each edge.

    Ids that lie close, as dense ones do, are found by a table of their range instead of sorting.
    """
    low, high = (min(u.min(), v.min()), max(u.max(), v.max())) if len(u) else (0, 0)
    if int(high) - int(low) < 2 * len(u):
        used = np.zeros(int(high) - int(low) + 1, bool)
        for x in (u, v):
            used[x - low] = True
        ids, place = np.flatnonzero(used) + low, np.cumsum(used, dtype=np.int32) - 1
        u, v = (place[x - low] for x in (u, v))
    else:
        ids = np.union1d(np.unique(u), np.unique(v))
        u, v = (np.searchsorted(ids, x).astype(np.int32) for x in (u, v))
    return ids, np.minimum(u, v), np.maximum(u, v)


def compressed(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


class Graph:
    """Edges (a < b, sum, cnt) between places 0 .. n - 1; ``near`` has [sum, cnt, changes] by neighbour."""

    def __init__(self, n: int, a: np.ndarray, b: np.ndarray, total: np.ndarray, count: np.ndarray):
        self.n, self.parent = n, np.arange(n, dtype=np.int32)
        self._set(a, b, total, count)

    def _set(self, a, b, total, count) -> None:
        self.a, self.b, self.total, self.count = a, b, total, count
        self.near: dict[int, dict[int, list]] = {}
        self.held = 0
        # half edges by node; the other end is a ^ b ^ node
        self.start = np.zeros(self.n + 1, np.int64)
        self.start[1:] = np.cumsum(np.bincount(a, minlength=self.n) + np.bincount(b, minlength=self.n))
        half = np.argsort(np.concatenate([a, b]), kind="stable")
        half %= max(len(a), 1)
        self.half = half.astype(np.int32)

    def root(self, x: int) -> int:
        up = self.parent
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    def of(self, x: int) -> dict[int, list]:
        """The edges of a node by neighbour, made when they are first asked for."""
        own = self.near.get(x)
        if own is None:
            at = self.half[self.start[x] : self.start[x + 1]]
            own = {}
            for y, s, c in zip((self.a[at] ^ self.b[at] ^ x).tolist(), self.total[at].tolist(), self.count[at].tolist()):
                r = self.root(y)
                there = self.near.get(r)
                own[r] = [s, c, 0] if there is None else there[x]
            self.near[x] = own
            self.held += len(own)
        return own

    def merge(self, u: int, v: int) -> Iterator[tuple[int, list]]:
        """Merge v into u; yield each neighbour whose edge to u is changed, with that edge."""
        kept, gone = self.of(u), self.of(v)
        self.parent[v] = u
        del kept[v], gone[u], self.near[v]
        self.held -= len(gone) + 2
        for w, e in gone.items():
            other = self.near.get(w)
            if other is not None:
                del other[v]
            old = kept.get(w)
            if old is None:
                self.held += 1
            else:
                e[0], e[1], e[2] = old[0] + e[0], old[1] + e[1], max(old[2], e[2])
            e[2] += 1
            kept[w] = e
            if other is not None:
                self.held -= old is not None
                other[u] = e
            yield w, e

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The edges as they are now."""
        made = np.zeros(self.n, bool)
        made[np.fromiter(self.near, np.int64, len(self.near))] = True
        dead = self.parent != np.arange(self.n)
        rest = ~(made[self.a] | made[self.b] | dead[self.a] | dead[self.b])
        sizes = np.fromiter((len(own) for own in self.near.values()), np.int64, len(self.near))
        n = int(sizes.sum())
        x = np.repeat(np.fromiter(self.near, np.int32, len(self.near)), sizes)
        y = np.fromiter((y for own in self.near.values() for y in own), np.int32, n)
        total, count = (np.fromiter((e[k] for own in self.near.values() for e in own.values()), kind.dtype, n) for k, kind in ((0, self.total), (1, self.count)))
        once = (x < y) | ~made[y]
        x, y, total, count = x[once], y[once], total[once], count[once]
        join = lambda old, own: np.concatenate([old[rest], own])
        return join(self.a, np.minimum(x, y)), join(self.b, np.maximum(x, y)), join(self.total, total), join(self.count, count)

    def freeze(self) -> None:
        self._set(*self.arrays())


def exact_mean(graph: Graph, threshold: float, window: int = 2_000_000) -> Iterator[tuple[int, int, float]]:
    """Merge the edge of the least (1 - sum / cnt, u, v) while that is below the threshold; yield (u, v, score).

    Scores are taken in windows of about that many edges: what waits for a later window is
    in the arrays only.  Where dicts grow beyond ``HELD``, the window starts again from arrays.
    """
    while True:
        if graph.near:
            graph.freeze()
        score = 1 - graph.total / graph.count
        live = np.flatnonzero(score < threshold)
        if not len(live):
            return
        end = threshold
        if len(live) > window:  # the window's end is a score that is not in it, so equal ones stay together
            least = np.partition(score[live], window)[window]
            above = score[live][score[live] > least]
            end = float(above.min()) if len(above) else threshold
            live = live[score[live] < end]
        a, b = graph.a[live], graph.b[live]
        order = np.lexsort((b, a, score[live]))
        a, b, score = a[order], b[order], score[live][order]
        at, heap, parent, near = 0, [], graph.parent, graph.near
        step = 1 << 16
        own: list = []
        while True:
            if at % step == 0:
                own = list(zip(score[at : at + step].tolist(), a[at : at + step].tolist(), b[at : at + step].tolist()))
            first = own[at % step] if at < len(a) else None
            if heap and (first is None or heap[0][:3] < first):
                s, u, v, changes = heapq.heappop(heap)
                e = near[u].get(v) if u in near else near[v].get(u) if v in near else None
                if e is None or e[2] != changes:
                    continue
            elif first is not None:
                s, u, v = first
                at += 1
                if parent[u] != u or parent[v] != v:
                    continue
                if u in near or v in near:
                    e = near[u].get(v) if u in near else near[v].get(u)
                    if e is None or e[2]:
                        continue
            else:
                break
            yield u, v, s
            for w, e in graph.merge(u, v):
                x = 1 - e[0] / e[1]
                if x < end:
                    heapq.heappush(heap, (x, u, w, e[2]) if u < w else (x, w, u, e[2]))
            if graph.held > HELD:
                break


def summed(a: np.ndarray, b: np.ndarray, total: np.ndarray, count: np.ndarray, n: int, at: np.ndarray | None = None):
    """Edges with parallel ones merged and inner ones left out; ``at``: where a and b have their total and count.

    Sums are of whole numbers, so equal edges may come in any order.
    """
    keep = np.flatnonzero(a != b)
    key = np.minimum(a, b)[keep].astype(np.int64)
    key *= n
    key += np.maximum(a, b)[keep]
    del a, b
    at = keep if at is None else at[keep]
    del keep
    order = np.argsort(key)
    key = key[order]
    at = at[order]
    del order
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    key = key[first]
    total, count = (np.add.reduceat(x[at], first, dtype=x.dtype) if len(first) else x[:0] for x in (total, count))
    return (key // n).astype(np.int32), (key % n).astype(np.int32), total, count


def contracted(step: np.ndarray, a: np.ndarray, b: np.ndarray, total: np.ndarray, count: np.ndarray):
    """Edges between the nodes that ``step`` (a root for each node) leaves.

    Edges that fall together each touch a node that has merged, so only such edges are sorted.
    """
    moved = np.flatnonzero(step != np.arange(len(step), dtype=step.dtype))
    touched = np.zeros(len(step), bool)
    touched[moved] = True
    touched[step[moved]] = True
    hit = touched[a] | touched[b]
    at = np.flatnonzero(hit)
    new = summed(step[a[at]], step[b[at]], total, count, len(step), at)
    del at
    rest = np.flatnonzero(~hit)
    return tuple(np.concatenate([x[rest], y]) for x, y in zip((a, b, total, count), new))


def bests(n: int, a: np.ndarray, b: np.ndarray, mean: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Each node's other end of its best live edge (largest mean, then least ends); -1 where it has none."""
    order = live[np.lexsort((-b[live], -a[live], mean[live]))]  # from worst to best: the last one written stays
    place, last = np.arange(len(order), dtype=np.int32), np.full(n, -1, np.int32)
    last[a[order]] = place
    np.maximum.at(last, b[order], place)
    out, has = np.full(n, -1, np.int32), np.flatnonzero(last >= 0)
    at = order[last[has]]
    out[has] = a[at] ^ b[at] ^ has.astype(np.int32)
    return out


def mutual_rounds(n: int, a: np.ndarray, b: np.ndarray, total: np.ndarray, count: np.ndarray, threshold: float, few: float = 0.01) -> np.ndarray:
    """Roots after rounds in which pairs merge that are each other's best edge above the threshold.

    Rounds go over all edges while more than ``few`` of the nodes merge in each.  Chains of
    ties go on for as many rounds as a lattice is long, with few merges in each; from there
    on a round costs what has changed: only nodes with a changed edge look for their best
    again, and only they can be in a new pair.
    """
    parent = np.arange(n, dtype=np.int32)
    while True:
        mean = total / count
        live = np.flatnonzero(mean > threshold)
        if not len(live):
            return compressed(parent)
        best = bests(n, a, b, mean, live)
        low = np.flatnonzero(best > np.arange(n))
        low = low[best[best[low]] == low]
        if len(low) <= few * n:
            break
        parent[best[low]] = low
        step = np.arange(n, dtype=np.int32)
        step[best[low]] = low
        a, b, total, count = summed(step[a], step[b], total, count, n)
    del mean, live
    graph = Graph(n, a, b, total, count)
    near, known = graph.near, best

    def search(x: int) -> int:
        """By the largest mean, then the least neighbour: the same order as by ends."""
        found, most = -1, threshold
        for y, e in graph.of(x).items():
            m = e[0] / e[1]
            if m > most or m == most and found >= 0 and y < found:
                found, most = y, m
        return found

    pairs = list(zip(low.tolist(), best[low].tolist()))
    while pairs:
        changed: dict[int, list] = {}
        for u, v in pairs:
            changed[u] = []
            for w, _ in graph.merge(u, v):
                graph.of(w)
                changed.setdefault(w, []).append(u)
        dirty = [x for x in changed if graph.parent[x] == x]
        for x in dirty:
            own, old, others = near[x], int(known[x]), changed[x]
            if not others or old < 0 or old not in own or old in others:
                known[x] = search(x)
                continue
            # its best edge is as it was: only changed ones may be better
            e = own[old]
            most = e[0] / e[1]
            for y in others:
                e = own.get(y)
                if e is not None:
                    m = e[0] / e[1]
                    if m > most or m == most and y < old:
                        old, most = y, m
            known[x] = old
        new = set()
        for x in dirty:
            y = int(known[x])
            if y >= 0 and known[y] == x:
                new.add((x, y) if x < y else (y, x))
        pairs = list(new)
    up = graph.parent
    return compressed(up[parent])
