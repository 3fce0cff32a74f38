"""All pairs in tiles and the least spanning tree against brute force, ties and copies included."""

import itertools

import numpy as np
import pandas as pd
import pytest

from kgloom.operators import all_pairs as P, density, neighbours as N
from kgloom.operators.spanning import forest


def kinds(rng, n):
    yield rng.normal(size=(n, 8))
    yield rng.integers(0, 3, size=(n, 2)).astype(float)  # many ties and copies
    yield np.round(rng.normal(size=(n, 2)) * 2) / 2 + 1e6
    yield np.repeat(rng.normal(size=(4, 3)), -(-n // 4), axis=0)[:n] + 1e-9 * rng.normal(size=(n, 3))  # near copies
    yield np.eye(n)  # all as far from each other
    yield rng.normal(size=(n, 3)) * 10.0 ** rng.integers(-200, 200, size=(n, 1))


def tasks(rows, groups):
    for low, high in itertools.combinations_with_replacement(range(groups), 2):
        some = rows[rows["group"].isin([low, high])]
        yield some.assign(other=np.where(some["group"] == low, high, low)).sample(frac=1, random_state=1)


def packed(points):
    return [np.float64(-1).tobytes() + v.tobytes() for v in points]


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
@pytest.mark.parametrize("tile,wait,groups,least", [(4, 20, 3, 5), (50, 10**6, 1, 2), (16, 20, 5, 10)])
def test_tasks_give_the_nearest_and_all_that_a_tree_lacks(monkeypatch, tile, wait, groups, least):
    monkeypatch.setattr(P, "TILE", tile)
    monkeypatch.setattr(P, "WAIT", wait)
    rng = np.random.default_rng(tile)
    for points in kinds(rng, 70):
        points = np.unique(points, axis=0)
        n, k = len(points), least - 1
        ids = np.sort(rng.permutation(3 * n)[:n])
        points = points[rng.permutation(n)]
        rows = pd.DataFrame({"id": ids, "vector": packed(points), "many": 1, "group": rng.integers(0, groups, n)})
        got = pd.concat([x for t in tasks(rows, groups) for x in P._nearest(k)(iter([t]))]).sort_values(["id", "distance", "hit"])
        got = got[got.groupby("id").cumcount() < k]
        d = np.array([N.distances(v, points) for v in points])
        near = [[m for m in np.lexsort((ids, d[x])) if m != x][:k] for x in range(n)]
        assert got["hit"].tolist() == [ids[m] for x in range(n) for m in near[x]] and got["distance"].tolist() == [d[x, m] for x in range(n) for m in near[x]]
        core = np.array([d[x, near[x][-1]] if near[x] else 0.0 for x in range(n)])
        reach = np.maximum(np.maximum(d, core[:, None]), core)
        # a tree that is far from the least one
        order = rng.permutation(n)
        ends = [sorted((int(order[x]), int(order[rng.integers(0, x)]))) for x in range(1, n)]
        tree = pd.DataFrame([(ids[a], ids[b], reach[a, b]) for a, b in ends], columns=["a", "b", "w"])
        path = rows.drop(columns="group").assign(core=core).merge(next(density._path(iter([tree]))), on="id")
        path["group"] = path["place"] * groups // n
        tops = [max([(-1.0, -1, -1), *path.loc[path["group"] == g, ["w", "a", "b"]].itertuples(index=False, name=None)]) for g in range(groups)]
        lacking = pd.concat([x for t in tasks(path, groups) for x in P._shorter(tops)(iter([t]))])
        found = forest(pd.concat([tree, lacking[lacking["kind"] == P.EDGE]])[["w", "a", "b"]])
        place = {x: p for p, x in enumerate(ids.tolist())}
        assert [(w, place[a], place[b]) for w, a, b in found.itertuples(index=False)] == density.dense_tree(points, least)


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_least_tree_of_a_table_in_groups(spark, monkeypatch):
    monkeypatch.setattr(P, "GROUP_ROWS", 20)
    rng = np.random.default_rng(3)
    few = rng.normal(size=(3, 2))
    for points, least in ((np.round(rng.normal(size=(150, 2)), 1), 4), (np.vstack([np.repeat(few, [40, 5, 3], axis=0), np.zeros((2, 2)), -np.zeros((2, 2)), rng.normal(size=(20, 2))])[rng.permutation(72)], 10), (np.ones((30, 2)), 3)):
        held = N.packed(N.clean(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(points)], "id long, vector array<double>")))
        with density.staged(spark) as put:
            tree = density.least_tree(held, len(points), least, least - 1, put).collect()
        assert sorted((r.w, r.a, r.b) for r in tree) == density.dense_tree(points, least)


def test_what_a_tile_rules_out_is_farther(monkeypatch):
    rng = np.random.default_rng(5)
    for offset, spread in ((0, 1), (1e6, 1e-3), (3, 1e-7), (0, 1e100)):
        one, other = (offset + spread * rng.normal(size=(90, 20)) for _ in range(2))
        tile = P._Tile(one, other)
        true = (np.array([N.distances(v, other) for v in one]) / tile.scale) ** 2
        assert tile.known and (tile.low <= true).all() and (true <= tile.low + tile.spare[0][:, None] + tile.spare[1]).all()
