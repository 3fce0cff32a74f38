"""All pairs of a table's vectors, in tiles: each vector's nearest and the edges by which a spanning tree is not yet a least one. Both are exact at every size.

The table is cut into groups and every two groups, and each with itself, are a task, so each vector goes once to as many tasks as there are groups. A task walks through the pairs in tiles of ``TILE`` by ``TILE``. A tile is one product
of matrices of floats that gives what a squared distance is at least, whatever is rounded; just the pairs that can be near enough by it are worked out in doubles, by ``neighbours.distances``.
There are as many groups as keep all cores busy, and more where a group's vectors would take over ``GROUP_BYTES``. The work is that of all pairs, n * n / 2 for n vectors; what leaves a task is a few numbers for each of its vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import neighbours as N
from .spanning import forest

TILE, GROUP_ROWS, GROUP_BYTES = 1024, 1000, 1 << 25
#: So many edges wait in a task before those that are in no least tree are dropped.
WAIT = 300_000
NONE = np.iinfo(np.int64).max
EDGE, FIRST = 0, 1


def groups_of(vectors: DataFrame, n: int) -> int:
    """In how many groups ``n`` packed vectors are held against each other."""
    size = 2 * (vectors.agg(F.sum(F.length("vector"))).first()[0] or 0)  # a task holds doubles
    busy = math.isqrt(6 * vectors.sparkSession.sparkContext.defaultParallelism) + 1
    return max(1, -(-size // GROUP_BYTES), min(busy, -(-n // GROUP_ROWS)))


def _dealt(rows: DataFrame, groups: int) -> DataFrame:
    """Rows with a ``group``, once for each task that holds it against another group."""
    other = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("other")
    low, high = F.least("group", "other"), F.greatest("group", "other")
    each = rows.select("*", other).withColumn("task", (high * (high + 1) / 2 + low).cast("int"))
    return each.repartitionById(groups * (groups + 1) // 2, "task").drop("task")


def _sides(batches: Iterator[pd.DataFrame], order: str) -> list[pd.DataFrame]:
    """The group of a task, or its two, each in its order; nothing if one of two has no rows."""
    held = [b for b in batches if len(b)]
    if not held:
        return []
    rows = pd.concat(held, ignore_index=True)
    sides = [side.sort_values(order, ignore_index=True) for _, side in rows.groupby("group", sort=True)]
    return sides if len(sides) == 2 or rows["group"].iloc[0] == rows["other"].iloc[0] else []


def _tiles(sides: list[pd.DataFrame]) -> Iterator[tuple[slice, slice]]:
    """Every two tiles that meet: those of both sides, or those of the one side, a tile with itself included."""
    a, b = len(sides[0]), len(sides[-1])
    for at in range(0, a, TILE):
        for to in range(at if len(sides) == 1 else 0, b, TILE):
            yield slice(at, min(a, at + TILE)), slice(to, min(b, to + TILE))


class _Tile:
    """What the squared distances of the rows of one matrix to those of another are at least, in units of a square: ``low``. They are no more than ``low`` + ``spare`` of both rows."""

    def __init__(self, one: np.ndarray, other: np.ndarray):
        with np.errstate(over="ignore", invalid="ignore"):
            middle = one.mean(axis=0)
            a, b = one - middle, other - middle
            self.scale = max(np.abs(a).max(), np.abs(b).max())
        self.known = bool(self.scale == 0 or 1e-140 < self.scale < 1e150)
        if not self.known:  # squares are infinite or 0 where distances are not: nothing is ruled out
            self.low = np.zeros((len(one), len(other)), dtype=np.float32)
            return
        self.scale = self.scale or 1.0
        a, b = (a / self.scale).astype(np.float32), (b / self.scale).astype(np.float32)
        part = np.float32((a.shape[1] + 8) * 2.0**-22)  # more than a sum of as many products of rounded floats can be wrong by
        a2, b2 = (a * a).sum(axis=1), (b * b).sum(axis=1)
        self.spare = 2 * part * a2, 2 * part * b2
        one, two = np.ones((len(a), 1), dtype=np.float32), np.ones((len(b), 1), dtype=np.float32)
        self.low = np.hstack([a, (a2 * (1 - part))[:, None], one]) @ np.hstack([-2 * b, two, (b2 * (1 - part))[:, None]]).T

    def reach(self, distance: np.ndarray) -> np.ndarray:
        """Distances in the units of ``low``, rounded up."""
        if not self.known:
            return np.full(distance.shape, np.inf, dtype=np.float32)
        with np.errstate(over="ignore"):
            return ((distance / self.scale) ** 2 * (1 + 1e-6) + 1e-30).astype(np.float32)

    def first(self, k: int, axis: int) -> np.ndarray:
        """For each row (axis 1) or column (axis 0) what its k nearest don't exceed, in the units of ``low``."""
        low = self.low if axis else np.ascontiguousarray(self.low.T)
        if not self.known or k > low.shape[1]:
            return np.full(len(low), np.inf, dtype=np.float32)
        own, others = self.spare if axis else self.spare[::-1]
        return np.partition(low, k - 1, axis=1)[:, k - 1] + own + others.max() + np.float32(1e-30)


def _pairs(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(wanted), wanted.shape[1])


def _exact(one: np.ndarray, other: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    step = max(1, (1 << 20) // one.shape[1])
    with np.errstate(over="ignore"):
        return np.concatenate([np.zeros(0), *(N.distances(one[a[k : k + step]], other[b[k : k + step]]) for k in range(0, len(a), step))])


class _Best:
    """The k least (distance, id) of each of n rows so far."""

    def __init__(self, n: int, k: int):
        self.k, self.d, self.ids, self.place = k, np.full((n, k), np.inf), np.full((n, k), NONE), np.full((n, k), -1)

    @property
    def unknown(self) -> np.ndarray:
        return self.ids[:, -1] == NONE

    def add(self, rows: np.ndarray, d: np.ndarray, ids: np.ndarray, place: np.ndarray) -> None:
        may = (d < self.d[rows, -1]) | ((d == self.d[rows, -1]) & (ids < self.ids[rows, -1]))
        rows, d, ids, place = rows[may], d[may], ids[may], place[may]
        if not len(rows):
            return
        touched = np.unique(rows)
        at = np.concatenate([np.repeat(np.arange(len(touched)), self.k), np.searchsorted(touched, rows)])
        d, ids, place = (np.concatenate([held[touched].ravel(), new]) for held, new in ((self.d, d), (self.ids, ids), (self.place, place)))
        order = np.lexsort((ids, d, at))
        keep = order[np.arange(len(at)) - np.searchsorted(at[order], at[order]) < self.k]
        for held, new in ((self.d, d), (self.ids, ids), (self.place, place)):
            held[touched] = new[keep].reshape(-1, self.k)


def _nearest(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides = _sides(batches, "id")
        if not sides:
            return
        ids, many, matrix = ([f(side) for side in sides] for f in (lambda s: s["id"].to_numpy(), lambda s: s["many"].to_numpy(), lambda s: N.matrix_of(s["vector"])))
        best = [_Best(len(x), k) for x in ids]
        for one, two in _tiles(sides):
            tile = _Tile(matrix[0][one], matrix[-1][two])
            same = len(sides) == 1 and one == two
            if same:
                np.fill_diagonal(tile.low, np.inf)
            found = []
            for place, axis in ((one, 1), (two, 0)):
                side = best[0 if axis else -1]
                d, unknown = tile.reach(side.d[place, -1]), side.unknown[place]
                found.append(np.where(unknown, np.minimum(d, tile.first(k, axis)), d) if unknown.any() else d)
            a, b = _pairs(tile.low <= found[0][:, None] if same else (tile.low <= found[0][:, None]) | (tile.low <= found[1]))
            if same:
                a, b = a[a != b], b[a != b]
            d = _exact(matrix[0][one], matrix[-1][two], a, b)
            a, b = a + one.start, b + two.start
            best[0].add(a, d, ids[-1][b], b)
            if not same:
                best[-1].add(b, d, ids[0][a], a)
        for n, side in enumerate(best):
            row, rank = np.nonzero(side.ids != NONE)
            hit = side.place[row, rank]
            yield pd.DataFrame({"id": ids[n][row], "hit": side.ids[row, rank], "distance": side.d[row, rank], "own": many[n][row], "many": many[n - 1][hit]})

    return run


def nearest(vectors: DataFrame, k: int, groups: int) -> DataFrame:
    """(id, hit, distance, own, many): just the k nearest of each of ``vectors`` (id, vector, many), packed, and the ``many`` of both."""
    rows = vectors.select("id", "many", "vector", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int").alias("group"))
    return N.nearest(_dealt(rows, groups).mapInPandas(_nearest(k), "id long, hit long, distance double, own long, many long"), k)


def _shorter(tops: list[tuple[float, int, int]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sides = _sides(batches, "place")
        if not sides:
            return
        ids, cores, many, matrix = ([f(side) for side in sides] for f in (lambda s: s["id"].to_numpy(), lambda s: s["core"].to_numpy(), lambda s: s["many"].to_numpy(), lambda s: N.matrix_of(s["vector"])))
        # step k of the path leads from its place k to the next; the first side's last one leads through the groups between
        w, a_of, b_of = (np.concatenate([side[c].to_numpy() for side in sides]) for c in ("w", "a", "b"))
        start, last = 0 if len(sides) == 1 else len(ids[0]), len(ids[0]) - 1
        low, high = (int(side["group"].iloc[0]) for side in (sides[0], sides[-1]))
        w[last], a_of[last], b_of[last] = max([(w[last], a_of[last], b_of[last]), *tops[low + 1 : high]])
        by_rank = np.lexsort((b_of, a_of, w))
        ranks = np.argsort(by_rank)
        held, waiting, firsts = [], 0, [np.full(len(x), NONE) for x in ids]

        def thinned() -> pd.DataFrame:
            """Of the edges that wait those that are in a least tree of these and the path."""
            n = len(w) - 1
            steps = pd.DataFrame({"w": w[:n], "a": a_of[:n], "b": b_of[:n], "one": np.arange(n), "two": np.arange(n) + 1, "step": True})
            kept = forest(pd.concat([*held, steps], ignore_index=True), ("one", "two"))
            return kept[~kept["step"].astype(bool)]

        for one, two in _tiles(sides):
            tile = _Tile(matrix[0][one], matrix[-1][two])
            x, y = one, slice(start + two.start, start + two.stop)
            reach = np.append(tile.reach(w[by_rank]), np.float32(-1))  # by ranks; -1: no step
            since = np.maximum.accumulate(np.append(-1, ranks[y][:-1]))
            if x == y:
                greatest = np.maximum.accumulate(np.where(np.tri(len(since), dtype=bool), -1, np.append(-1, ranks[y][:-1])), axis=1)
                p, q = _pairs(tile.low <= reach[greatest])
                top = greatest[p, q]
            else:
                until = np.maximum.accumulate(np.append(ranks[x], ranks[x.stop : y.start].max(initial=-1))[::-1])[::-1][:-1]
                p, q = _pairs((tile.low <= reach[until][:, None]) | (tile.low <= reach[since]))
                top = np.maximum(until[p], since[q])
            if x == y:
                forward = p < q
                p, q, top = p[forward], q[forward], top[forward]
            if not len(p):
                continue
            top = by_rank[top]
            d = _exact(matrix[0][one], matrix[-1][two], p, q)
            p, q = p + one.start, q + two.start
            first, second = ids[0][p], ids[-1][q]
            far = np.maximum(np.maximum(d, cores[0][p]), cores[-1][q])
            for n, place, own, other in ((0, p, first, second), (-1, q, second, first)):
                least = (many[n][place] > 1) & (far == cores[n][place]) & (other < own)
                np.minimum.at(firsts[n], place[least], other[least])
            a, b = np.minimum(first, second), np.maximum(first, second)
            less = (far < w[top]) | ((far == w[top]) & ((a < a_of[top]) | ((a == a_of[top]) & (b < b_of[top]))))
            if less.any():
                held.append(pd.DataFrame({"w": far[less], "a": a[less], "b": b[less], "one": p[less], "two": q[less] + start, "step": False}))
                waiting += int(less.sum())
                if waiting > max(WAIT, 2 * len(w)):
                    held = [thinned()]
                    waiting = len(held[0])
        for found in [thinned()] if waiting > len(w) else held:
            yield found.assign(kind=EDGE)[["kind", "a", "b", "w"]]
        for n, side in enumerate(firsts):
            at = np.flatnonzero(side != NONE)
            yield pd.DataFrame({"kind": FIRST, "a": ids[n][at], "b": side[at], "w": cores[n][at]})

    return run


def shorter(vectors: DataFrame, path: DataFrame, n: int, groups: int) -> DataFrame:
    """What a spanning tree by mutual reachability lacks to be the least, ties by a and b. ``vectors``: (id, vector, many, core), packed. ``path``: (id, place, w, a, b), the tree's vectors in such an order that the greatest edge of the
    tree between two of them is the greatest of the steps from one place to the next, w, a and b, between them.

    (kind, a, b, w): of kind ``EDGE`` each pair that comes before the greatest edge of the tree between its two, or some of these, without those that are in no least tree; of kind ``FIRST`` for vectors with copies the least id ``b`` below
    their own, ``a``, that is as near as their core (the least of several rows).
    """
    place = path.withColumn("group", F.expr(f"cast(place * {groups} div {n} AS int)"))
    tops = {r["group"]: tuple(r["top"]) for r in place.groupBy("group").agg(F.max(F.struct("w", "a", "b")).alias("top")).collect()}  # a row for each group
    tops = [tops.get(k, (-1.0, -1, -1)) for k in range(groups)]
    return _dealt(vectors.join(place, "id"), groups).mapInPandas(_shorter(tops), "kind int, a long, b long, w double")
