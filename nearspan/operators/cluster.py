"""Order-dependent splits of one group of objects, as pandas functions for applyInPandas.

A group is one overfull ball, so its size is bounded by the index's capacity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

from .dag import edit_distance

Distance = Callable[[str, str], float]


def _draw(key: object, seed: int) -> str:
    return hashlib.md5(f"{seed}:{key}".encode(), usedforsecurity=False).hexdigest()


def random_promotion(items: list[str], seed: int = 42) -> tuple[str, str]:
    """Two objects by a seeded hash."""
    a, b = sorted(items, key=lambda x: (_draw(x, seed), x))[:2]
    return a, b


def extreme_promotion(items: list[str]) -> tuple[str, str]:
    """The least and the greatest object."""
    return min(items), max(items)


def balanced_partition(a: str, b: str, items: list[str], distance: Distance = edit_distance) -> tuple[list[str], list[str]]:
    """Halves that take turns: each side takes the nearest object that is left."""
    halves: tuple[list[str], list[str]] = ([], [])
    rest = [sorted(items, key=lambda x: (distance(p, x), x)) for p in (a, b)]
    taken: set[str] = set()
    side = 0
    while len(taken) < len(items):
        queue = rest[side]
        while queue and queue[0] in taken:
            queue.pop(0)
        if queue:
            x = queue.pop(0)
            taken.add(x)
            halves[side].append(x)
        side = 1 - side
    return halves


def minimax_center(items: list[str], distance: Distance) -> tuple[str, float]:
    """The object with the least greatest distance to the others."""
    return min(((x, max(distance(x, y) for y in items)) for x in items), key=lambda r: (r[1], r[0]))


def agglomerate(items: list[str], distance: Distance = edit_distance, most_share: float = 0.6, most_growth: float = 1.5) -> list[list[str]]:
    """Merges the two clusters with the nearest centers until two are left, or a merge would
    hold over most_share of all objects or grow the radius over most_growth times."""
    memo: dict[tuple[str, str], float] = {}

    def d(x: str, y: str) -> float:
        key = (x, y) if x <= y else (y, x)
        if key not in memo:
            memo[key] = distance(*key)
        return memo[key]

    clusters = [([x], x, 0.0) for x in sorted(set(items))]
    while len(clusters) > 2:
        _, i, j = min((d(clusters[i][1], clusters[j][1]), i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters)))
        merged = clusters[i][0] + clusters[j][0]
        center, radius = minimax_center(merged, d)
        before = max(clusters[i][2], clusters[j][2])
        if len(merged) > most_share * len(set(items)) or (before > 0 and radius > most_growth * before and len(merged) > 3):
            break
        clusters = [c for k, c in enumerate(clusters) if k not in (i, j)] + [(merged, center, radius)]
    return [c[0] for c in clusters]


def two_way(items: list[str], seed: int = 42, distance: Distance = edit_distance) -> tuple[list[str], list[str], int, int]:
    """Random promotion and balanced partition, with the members nearer to the other side."""
    a, b = random_promotion(items, seed)
    left, right = balanced_partition(a, b, items, distance)
    return left, right, sum(distance(b, x) < distance(a, x) for x in left), sum(distance(a, x) < distance(b, x) for x in right)


def split_groups(groups: DataFrame, method: str = "agglomerate") -> DataFrame:
    """groups (g, s) with a `part` for each string of an overfull group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        items = sorted(set(rows["s"]))
        if len(items) < 2:
            parts = [items]
        elif method == "agglomerate":
            parts = agglomerate(items)
        elif method == "two_way":
            parts = list(two_way(items)[:2])
        else:
            raise ValueError(f"unknown method {method!r}")
        out = pd.DataFrame([(x, i) for i, p in enumerate(parts) for x in p], columns=["s", "part"])
        out.insert(0, "g", rows["g"].iloc[0])
        return out

    return groups.groupBy("g").applyInPandas(run, f"g {groups.schema['g'].dataType.simpleString()}, s string, part int")
