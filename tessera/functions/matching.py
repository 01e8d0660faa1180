"""Maximum-weight bipartite matching of small sides."""

from __future__ import annotations

import difflib


def assign(weights: dict[tuple[str, str], float]) -> list[tuple[str, str]]:
    """The matching of largest total weight over the given edges (all weights above 0), as sorted pairs.

    Shortest augmenting paths with potentials, after padding with edges of weight 0 that stand for "unmatched". Equal totals: names in order decide.
    """
    left, right = sorted({a for a, _ in weights}), sorted({b for _, b in weights})
    n = max(len(left), len(right))
    cost = [[-weights.get((left[i], right[j]), 0.0) if i < len(left) and j < len(right) else 0.0 for j in range(n)] for i in range(n)]
    u, v, owner = [0.0] * n, [0.0] * (n + 1), [-1] * (n + 1)
    for i in range(n):
        owner[n], at = i, n
        dist, via, done = [float("inf")] * n, [n] * n, [False] * (n + 1)
        while owner[at] != -1:
            done[at] = True
            row, step, best = owner[at], float("inf"), -1
            for j in range(n):
                if done[j]:
                    continue
                d = cost[row][j] - u[row] - v[j]
                if d < dist[j]:
                    dist[j], via[j] = d, at
                if dist[j] < step:
                    step, best = dist[j], j
            for j in range(n + 1):
                if done[j]:
                    u[owner[j]] += step
                    v[j] -= step
                elif j < n:
                    dist[j] -= step
            at = best
        while at != n:
            owner[at] = owner[via[at]]
            at = via[at]
    return sorted((left[owner[j]], right[j]) for j in range(n) if owner[j] < len(left) and j < len(right) and (left[owner[j]], right[j]) in weights)


def name_similarity(a: str, b: str) -> float:
    """Share of letters and digits in common runs, whatever the case and separators: 0 to 1."""
    x, y = ("".join(c for c in s.lower() if c.isalnum()) for s in (a, b))
    return difflib.SequenceMatcher(None, x, y, autojunk=False).ratio()
