"""Disjoint sets and least spanning forests of edges in memory."""

from __future__ import annotations

import numpy as np
import pandas as pd


class Sets:
    """Disjoint sets of ids."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (parent := up.setdefault(x, x)) != x:
            up[x] = x = up[parent] = up.setdefault(parent, parent)
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def forest(edges: pd.DataFrame, ends: tuple[str, str] = ("a", "b")) -> pd.DataFrame:
    """The minimum spanning forest of edges (a, b, w), ties by a and b. ``ends``: what an edge ties, if not these."""
    ordered = edges.sort_values(["w", "a", "b"], kind="stable")
    sets = Sets()
    keep = [sets.join(a, b) for a, b in zip(ordered[ends[0]].tolist(), ordered[ends[1]].tolist())]
    return ordered[np.array(keep, dtype=bool)]
