"""Dense versions of what the library does on sparse pairs."""

import numpy as np


def min_cost_matching(cost: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one assignment of all rows of the shorter side at minimum total cost.

    Successive shortest augmenting paths with potentials.
    """
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((r, c) for c, r in min_cost_matching(cost.T))
    n, m = cost.shape
    row_pot, col_pot = np.zeros(n), np.zeros(m)
    owner = np.full(m, -1)
    for row in range(n):
        dist = np.full(m, np.inf)
        via = np.full(m, -1)
        done = np.zeros(m, dtype=bool)
        base, r, last = 0.0, row, -1
        while True:
            reach = base + cost[r] - row_pot[r] - col_pot
            closer = ~done & (reach < dist)
            dist[closer] = reach[closer]
            via[closer] = last
            col = int(np.argmin(np.where(done, np.inf, dist)))
            base = dist[col]
            done[col] = True
            if owner[col] < 0:
                break
            r, last = int(owner[col]), col
        gain = base - dist[done]
        row_pot[row] += base
        held = [c for c in np.flatnonzero(done) if owner[c] >= 0]
        for c in held:
            row_pot[owner[c]] += base - dist[c]
        col_pot[done] -= gain
        while col >= 0:
            prev = int(via[col])
            owner[col] = owner[prev] if prev >= 0 else row
            col = prev
    return sorted((int(owner[c]), c) for c in range(m) if owner[c] >= 0)


def dense_linkage(n: int, pairs, limit: float) -> list[int]:
    """Cluster labels of ``n`` items; ``pairs`` are (i, j, distance <= limit).

    Pairs that are not listed are too far apart. Clusters merge as long as the
    largest distance between two of them is within the limit, nearest first.
    """
    far = np.inf
    d = np.full((n, n), far)
    for i, j, v in pairs:
        d[i, j] = d[j, i] = v
    label = list(range(n))
    while n > 1:
        flat = int(np.argmin(d))
        i, j = sorted(divmod(flat, d.shape[0]))
        if not d[i, j] <= limit:
            break
        merged = np.maximum(d[i], d[j])
        d[i], d[:, i] = merged, merged
        d[i, i] = far
        d[j], d[:, j] = far, far
        label = [i if v == j else v for v in label]
    return label
