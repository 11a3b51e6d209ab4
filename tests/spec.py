"""A plain sequential specification in NumPy, for comparison only."""

import numpy as np


def canonical(labels):
    flat, names = labels.reshape(-1), {0: 0}
    return np.array([names.setdefault(int(v), len(names)) for v in flat])


def flow(aff, low, high):
    _, Z, Y, X = aff.shape
    bits = np.zeros((Z, Y, X), int)
    for z, y, x in np.ndindex(Z, Y, X):
        side = [
            aff[0, z, y, x] if z else None, aff[1, z, y, x] if y else None, aff[2, z, y, x] if x else None,
            aff[0, z + 1, y, x] if z + 1 < Z else None, aff[1, z, y + 1, x] if y + 1 < Y else None, aff[2, z, y, x + 1] if x + 1 < X else None,
        ]
        m = max((s for s in side if s is not None), default=low)
        if m > low:
            bits[z, y, x] = sum(1 << d for d, s in enumerate(side) if s is not None and (s == m or s >= high))
    return bits


def watershed(aff, low, high):
    """Labels by rule: ranks of all cells by their distance from the outlets, then what each cell keeps, then components.

    Cells are ranked in waves: the outlets by number, then those that a wave's cells exchange
    with, by the rank of the first such cell and the direction from there.  A ranked cell keeps
    the last direction towards a cell that doesn't answer or has a lower rank; others keep all.
    """
    _, Z, Y, X = aff.shape
    step = [-Y * X, -X, -1, Y * X, X, 1]
    first = flow(aff, low, high).reshape(-1).tolist()
    out = [[(d, i + step[d]) for d in range(6) if v >> d & 1] for i, v in enumerate(first)]
    answers = lambda i, j: any(k == i for _, k in out[j])
    wave = [i for i in range(len(first)) if any(not answers(i, j) for _, j in out[i])]
    rank = {}
    while wave:
        rank.update({i: len(rank) + n for n, i in enumerate(wave)})
        reached = {}
        for i in wave:
            for d, j in out[i]:
                if answers(i, j) and j not in rank:
                    reached[j] = min(reached.get(j, (rank[i], d)), (rank[i], d))
        wave = sorted(reached, key=reached.get)
    kept = [[j for _, j in o] if i not in rank else [j for _, j in o if not answers(i, j) or rank[j] < rank[i]][-1:] for i, o in enumerate(out)]
    touched = {i for i, o in enumerate(kept) if o} | {j for o in kept for j in o}
    near = {i: set() for i in touched}
    for i, o in enumerate(kept):
        for j in o:
            near[i].add(j)
            near[j].add(i)
    labels, n = [0] * len(first), 0
    for i in sorted(touched):
        if not labels[i]:
            n, stack = n + 1, [i]
            while stack:
                k = stack.pop()
                if not labels[k]:
                    labels[k] = n
                    stack.extend(near[k])
    return np.array(labels).reshape(Z, Y, X)


def graph(aff, frag):
    out = {}
    for c in range(3):
        for p in np.ndindex(frag.shape):
            if p[c]:
                q = tuple(v - (i == c) for i, v in enumerate(p))
                a, b = int(frag[p]), int(frag[q])
                if a and b and a != b:
                    e = out.setdefault((min(a, b), max(a, b)), [0, 0])
                    e[0] += int(aff[(c, *p)])
                    e[1] += 1
    return out


def merge(edges, threshold):
    """Contact-mean merging by full scans: (sum, count) edges, merge while mean > threshold."""
    edges, up = {k: list(v) for k, v in edges.items()}, {}
    while True:
        best = min(((-s / n, u, v) for (u, v), (s, n) in edges.items()), default=None)
        if best is None or -best[0] <= threshold:
            return up
        _, u, v = best
        up[v] = u
        nxt = {}
        for (a, b), (s, n) in edges.items():
            a, b = (u if a == v else a), (u if b == v else b)
            if a != b:
                e = nxt.setdefault((min(a, b), max(a, b)), [0, 0])
                e[0] += s
                e[1] += n
        edges = nxt
