"""Small numeric helpers for one frame of one site."""

from __future__ import annotations

import heapq
from operator import itemgetter

import numpy as np


def complete_linkage(n: int, pairs, limit: float) -> list[int]:
    """Cluster labels of ``n`` items; ``pairs`` are (i, j, distance).

    Pairs that are not listed, or beyond the limit, are too far apart. Clusters merge as long as the
    largest distance between two of them is within the limit, nearest first; a
    cluster is named after its first item. Only listed pairs are held: two clusters stay
    neighbours while all pairs between them are.
    """
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, d in pairs:
        if d <= limit:
            near[i][j] = near[j][i] = d
    heap = [(d, i, j) for i, row in enumerate(near) for j, d in row.items() if i < j]
    heapq.heapify(heap)
    label = list(range(n))
    inside = [[i] for i in range(n)]
    while heap:
        d, i, j = heapq.heappop(heap)
        if near[i].get(j) != d:
            continue  # one of the two has changed since
        gone = near[j]
        near[j] = {}
        for k, e in gone.items():
            if k != i:
                del near[k][j]
                if k not in near[i]:
                    continue
                far = max(e, near[i][k])
                if far != near[i][k]:
                    near[i][k] = near[k][i] = far
                    heapq.heappush(heap, (far, min(i, k), max(i, k)))
        del near[i][j]
        for k in [k for k in near[i] if k not in gone]:
            del near[i][k], near[k][i]
        for v in inside[j]:
            label[v] = i
        inside[i] += inside[j]
    return label


def _linked(n: int, i, j, d) -> np.ndarray:
    """:func:`complete_linkage` of ``n`` items by arrays; i < j, each pair once.

    Two items that are each other's nearest, by (distance, i, j), merge whatever else does, as a cluster is never nearer to a third
    than both of its parts are; so all such pairs merge in one round.
    """
    label = np.arange(n)
    while len(i):
        order = np.lexsort((j, i, d))
        i, j, d = i[order], j[order], d[order]
        rank = np.arange(len(i))
        first = np.full((2, n), len(i))
        first[0, i[::-1]], first[1, j[::-1]] = rank[::-1], rank[::-1]  # the last one written is the nearest
        nearest = first.min(axis=0)
        both = (nearest[i] == rank) & (nearest[j] == rank)
        step, parts = np.arange(n), np.ones(n, np.int64)
        step[j[both]] = i[both]
        parts[i[both]] = 2
        label = step[label]
        i, j, d = step[i[~both]], step[j[~both]], d[~both]
        i, j = np.minimum(i, j), np.maximum(i, j)
        i, j, d = _folded(n, i, j, d, parts)
    return label


def _folded(n: int, i, j, d, parts) -> tuple:
    """The largest distance of pairs (i, j) that come as often as their parts make pairs; others are gone."""
    order = np.argsort(i * n + j, kind="stable")
    i, j, d = i[order], j[order], d[order]
    starts = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(i) else np.array([], np.int64)
    far = np.maximum.reduceat(d, starts) if len(i) else d
    i, j, times = i[starts], j[starts], np.diff(np.r_[starts, len(d)])
    whole = times == parts[i] * parts[j]
    return i[whole], j[whole], far[whole]


def linked_places(x, y, kind, may, able, who, same, limit: float) -> np.ndarray:
    """Complete-linkage labels of places of some kinds; ``may[a, b]``: kinds a and b may be in one cluster, symmetric.

    Places are near if both are ``able`` and differ in ``who``; ``same`` (i, j), i < j: pairs at distance 0. The reach grows step by step
    up to the limit. Only the first places of clusters are paired, where each has room for the other's kinds; all others are
    compared for what that finds, so in a crowd few pairs are made.
    """
    n = len(x)
    label, equal = np.arange(n), same[0] * n + same[1]
    for reach in [limit / 16, limit / 8, limit / 4, limit / 2, limit] if n > 64 else [limit]:
        names, no, size = np.unique(label, return_inverse=True, return_counts=True)
        order, start = np.argsort(no, kind="stable"), np.cumsum(size) - size
        fits = np.logical_and.reduceat(may[kind[order]], start)
        has = np.zeros_like(fits)
        has[no, kind] = True
        head = order[start]
        open_ = np.flatnonzero((fits & has[fits.any(axis=1)].any(axis=0)).any(axis=1) & able[head])
        hx, hy = x[head[open_]], y[head[open_]]
        a, b, _ = near_arrays(hx, hy, hx, hy, reach * (1 + 1e-9))
        a, b = open_[a[a < b]], open_[b[a < b]]
        one, two = no[same[0]], no[same[1]]
        a, b = np.r_[a, np.minimum(one, two)[one != two]], np.r_[b, np.maximum(one, two)[one != two]]
        ok = ~(has[b] & ~fits[a]).any(axis=1)
        a, b = a[ok], b[ok]
        if len(equal):
            _, single = np.unique(a * n + b, return_index=True)
            a, b = a[single], b[single]
        pairs = size[a] * size[b]
        begin = np.cumsum(pairs) - pairs
        at = np.repeat(np.arange(len(a)), pairs)
        k = np.arange(len(at)) - begin[at]
        i, j = order[start[a][at] + k // size[b][at]], order[start[b][at] + k % size[b][at]]
        i, j = np.minimum(i, j), np.maximum(i, j)
        d = np.sqrt((x[j] - x[i]) * (x[j] - x[i]) + (y[j] - y[i]) * (y[j] - y[i]))
        d[~((d <= reach) & able[i] & able[j] & (who[i] != who[j]))] = np.inf
        if len(equal):
            d[np.isin(i * n + j, equal)] = 0.0
        far = np.maximum.reduceat(d, begin) if len(a) else d
        near = far <= reach
        label = names[_linked(len(names), a[near], b[near], far[near])[no]]
    return label


def near_arrays(ax, ay, bx, by, limit: float):
    """Indices i, j and distances of points of two sets within the limit; only points near in x are compared."""
    order = np.argsort(bx, kind="stable")
    lo = np.searchsorted(bx[order], ax - limit, side="left")
    n = np.searchsorted(bx[order], ax + limit, side="right") - lo
    i = np.repeat(np.arange(len(ax)), n)
    j = order[np.repeat(lo, n) + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)]
    d = np.hypot(ax[i] - bx[j], ay[i] - by[j])
    ok = d <= limit
    return i[ok], j[ok], d[ok]


def near_pairs(ax, ay, bx, by, limit: float):
    """(i, j, distance) of points of two sets within the limit."""
    return zip(*[v.tolist() for v in near_arrays(ax, ay, bx, by, limit)])


def best_pairing(options: list[list[tuple[int, float]]], alone: float) -> list[tuple[int, int]]:
    """One-to-one pairs (row, column) of least total cost, a row without partner costing ``alone``.

    ``options[row]`` lists (column, cost) of the pairs allowed. Rows enter one by
    one; each looks for the cheapest chain of exchanges, by Dijkstra's search
    over costs that potentials keep from being negative. Rows that share no
    chain of options never meet, so separate groups are solved separately.

    Options are read from the cheapest on, and only up to the nearest column
    that is free: the search ends there at the latest. The smaller side enters, as what
    finds no free column goes through all that its chains reach.
    """
    width = 1 + max((col for row in options for col, _ in row), default=-1)
    if sum(map(bool, options)) > len({col for row in options for col, _ in row}):
        other: list[list[tuple[int, float]]] = [[] for _ in range(width)]
        for row, found in enumerate(options):
            for col, cost in found:
                other[col].append((row, cost))
        return sorted((row, col) for col, row in best_pairing(other, alone))
    options = [sorted(row, key=itemgetter(1)) for row in options]
    none = float("inf")
    row_pot = [0.0] * len(options)
    col_pot = [0.0] * width
    slack = 0.0  # the highest potential of a column; above 0 by rounding only
    owner: list[int] = [-1] * width
    via: list[int] = [-1] * width
    dist = [none] * width  # of the columns reached and not passed; -inf once passed
    partner: dict[int, int] = {}
    for start in range(len(options)):
        done: list[tuple[int, float]] = []
        reached: list[int] = []
        heap: list[tuple[float, int]] = []
        base, row = 0.0, start
        stop, stop_row = none, start
        free = none  # distance of the nearest free column seen
        while True:
            own = row_pot[row]
            if base + alone - own < stop:
                stop, stop_row = base + alone - own, row
            far = min(free, stop)
            for col, cost in options[row]:
                least = base + cost - own
                if least - slack > far:
                    break
                d = least - col_pot[col]
                if d < dist[col] and d <= far and d < stop:
                    reached.append(col)
                    dist[col], via[col] = d, row
                    heapq.heappush(heap, (d, col))
                    if owner[col] < 0:
                        free = far = d
            while heap and heap[0][0] > dist[heap[0][1]]:
                heapq.heappop(heap)
            if not heap or heap[0][0] >= stop:
                end = None
                break
            base, col = heapq.heappop(heap)
            if owner[col] < 0:
                stop, end = base, col
                break
            done.append((col, base))
            dist[col] = -none
            row = owner[col]
        for col in reached:
            dist[col] = none
        row_pot[start] += stop
        for col, at in done:
            row_pot[owner[col]] += stop - at
            col_pot[col] -= stop - at
            if col_pot[col] > slack:
                slack = col_pot[col]
        if end is None:  # some row on the way stays alone
            if stop_row == start:
                continue
            end = partner.pop(stop_row)
        while True:  # hand the columns on, back to the new row
            row = via[end]
            owner[end] = row
            before = partner.get(row)
            partner[row] = end
            if row == start:
                break
            end = before
    return sorted(partner.items())
