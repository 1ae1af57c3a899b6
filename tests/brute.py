"""Slow, obvious versions of the harder operators for small inputs."""

from __future__ import annotations

from fractions import Fraction


def mismatches(a: str, b: str) -> int:
    return sum(x != y for x, y in zip(a, b))


def average_linkage(ranked: list[str], cut: float) -> list[frozenset[str]]:
    """Sequential average linkage: merge the closest pair, ties by smallest ranks."""
    k = len(ranked[0])
    clusters = {i: [w] for i, w in enumerate(ranked)}
    while True:
        best = None
        ids = sorted(clusters)
        for n, i in enumerate(ids):
            for j in ids[n + 1 :]:
                total = sum(mismatches(a, b) for a in clusters[i] for b in clusters[j])
                size = k * len(clusters[i]) * len(clusters[j])
                if total / size <= cut:
                    found = (Fraction(total, size), i, j)
                    if best is None or found < best:
                        best = found
        if best is None:
            return [frozenset(c) for c in clusters.values()]
        _, i, j = best
        clusters[i] += clusters.pop(j)
