"""Neighbour graphs, density clusters and the vector index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.operators import density, neighbours as N


def table(spark, matrix):
    return spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(matrix)], "id long, vector array<double>")


def blobs(n, dims=6, noise=0.1, seed=3, centres=6):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims)) * 8
    spread = rng.uniform(0.4, 1.6, centres)
    which = rng.integers(0, centres, n)
    points = middle[which] + rng.normal(size=(n, dims)) * spread[which, None]
    stray = rng.random(n) < noise
    points[stray] = rng.uniform(-20, 20, (int(stray.sum()), dims))
    points[5] = points[6] = points[7]
    return points


def plain_clusters(points, least):
    """The definition, top down: the longest edges of the tree go, and the parts that are left are told apart by walking them."""
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, least - 1]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    n = len(points)
    # ties go by ids, in the tree and when it is taken apart; an edge is of the tree if no path of lesser ones ties its ends
    group, edges = list(range(n)), []
    a, b = np.triu_indices(n, 1)
    for k in np.lexsort((b, a, reach[a, b])):
        one, other = group[a[k]], group[b[k]]
        if one != other:
            edges.append((reach[a[k], b[k]], int(a[k]), int(b[k])))
            group = [one if g == other else g for g in group]
            if len(edges) == n - 1:
                break
    around = {k: {} for k in range(n)}
    for w, a, b in edges:
        around[a][b] = around[b][a] = w

    def reached(start):
        seen, stack = {start}, [start]
        while stack:
            for other in around[stack.pop()]:
                if other not in seen:
                    seen.add(other)
                    stack.append(other)
        return seen

    # each cluster: its birth, its members' leaving densities, its children
    clusters = [{"birth": 0.0, "leaves": {}, "children": []}]
    part_of = {k: 0 for k in range(n)}
    for w, a, b in sorted(edges, reverse=True):
        now = 1 / max(w, 1e-9)
        del around[a][b], around[b][a]
        c = part_of[a]
        if c is None:
            continue
        left, right = reached(a), reached(b)
        if len(left) >= least and len(right) >= least:
            for side in (left, right):
                clusters[c]["children"].append(len(clusters))
                clusters.append({"birth": now, "leaves": {}, "children": []})
                for x in side:
                    clusters[c]["leaves"][x] = now
                    part_of[x] = len(clusters) - 1
        else:
            for side in (left, right):
                if len(side) < least:
                    for x in side:
                        if part_of[x] is not None:
                            clusters[c]["leaves"][x] = now
                            part_of[x] = None
    stable = lambda c: sum(x - c["birth"] for x in c["leaves"].values())

    def choose(k):
        own, below = stable(clusters[k]), [choose(c) for c in clusters[k]["children"]]
        beneath = sum(s for s, _ in below)
        return (own, [k]) if k and own >= beneath else (max(beneath, own) if k else 0, [c for _, chosen in below for c in chosen])

    labels = np.full(n, -1)
    for c in choose(0)[1]:
        for x in clusters[c]["leaves"]:
            labels[x] = c
    return labels


def same_partition(one, other):
    pairs = set(zip(one.tolist(), other.tolist()))
    return len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs}) and all((a == -1) == (b == -1) for a, b in pairs)


def labels_of(df, n):
    out = np.full(n, -2)
    for r in df.collect():
        out[r.id] = r.cluster
    return out


@pytest.mark.parametrize("least", [5, 10])
def test_condensed_tree_is_that_of_the_definition(least):
    for seed in range(6):
        points = blobs(220, seed=seed)
        d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
        core = np.sort(d, axis=1)[:, least - 1]
        import pandas as pd

        a, b = np.triu_indices(len(points), 1)
        edges = density.forest(pd.DataFrame({"a": a, "b": b, "w": np.maximum(np.maximum(d[a, b], core[a]), core[b])}))
        found = density.condensed(list(zip(edges["w"], edges["a"].tolist(), edges["b"].tolist())), len(points), least)
        want = plain_clusters(points, least)
        assert same_partition(found, want) and len(set(want.tolist())) > 3


def test_exact_clusters_of_a_table(spark):
    points = blobs(300, seed=9)
    found = labels_of(density.density_clusters(table(spark, points), least=8, cosine=False), len(points))
    assert same_partition(found, plain_clusters(points, 8))


def test_clusters_of_two_thousand_vectors(spark):
    points = blobs(2000, seed=4)
    want = plain_clusters(points, 10)
    assert len(set(want.tolist())) > 4 and (want == -1).sum() > 50
    assert same_partition(labels_of(density.density_clusters(table(spark, points), cosine=False), len(points)), want)
    # the neighbour graph finds the same clusters; some vectors at their rims differ
    found = labels_of(density.density_clusters(table(spark, points), dense=0, cosine=False), len(points))
    both = (found >= 0) & (want >= 0)
    assert same_partition(found[both], want[both]) and ((found >= 0) == (want >= 0)).mean() > 0.995


@pytest.mark.parametrize("least", [2, 10])
def test_dense_tree_is_that_of_all_edges(least):
    import pandas as pd

    points = np.round(blobs(150, dims=2, seed=6))  # many ties
    d = np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, least - 1]
    a, b = np.triu_indices(len(points), 1)
    want = density.forest(pd.DataFrame({"a": a, "b": b, "w": np.maximum(np.maximum(d[a, b], core[a]), core[b])}))
    assert density.dense_tree(points, least) == list(zip(want["w"].tolist(), want["a"].tolist(), want["b"].tolist()))


def test_small_odd_and_hot_tables(spark):
    assert density.density_clusters(table(spark, np.eye(5))).count() == 0
    rng = np.random.default_rng(1)
    same = np.vstack([np.tile([1.0, 0, 0], (60, 1)), np.tile([0, 1.0, 0], (30, 1)), np.array([[0, 0, 1.0]]), rng.normal(size=(9, 3)) * 50])
    rows = table(spark, same).withColumn("cluster", F.lit("x"))
    odd = spark.createDataFrame([(500, None, "x"), (None, [1.0, 0.0, 0.0], "x"), (501, [float("nan"), 0.0, 0.0], "x"), (502, [1.0], "x"), (3, [9.0, 9.0, 9.0], "x")], "id long, vector array<double>, cluster string")
    found = {r.id: r.cluster for r in density.density_clusters(rows.unionByName(odd), cosine=False).collect()}
    assert set(found) == set(range(100)) and {found[k] for k in range(60)} == {0} and {found[k] for k in range(60, 90)} == {1}


def test_vectors_beyond_the_sample_follow_their_neighbours(spark):
    points = blobs(600, noise=0.0, seed=2, centres=3)
    found = labels_of(density.density_clusters(table(spark, points), most=300, dense=0, cosine=False), len(points))
    whole = plain_clusters(points, 10)
    both = (found >= 0) & (whole >= 0)
    assert both.mean() > 0.7 and same_partition(found[both], whole[both])


def test_neighbour_graph_finds_the_exact_one(spark):
    rows = N.clean(table(spark, np.random.default_rng(5).normal(size=(1500, 24))))
    exact = N.exact_graph(rows, 15)
    assert exact.count() == 1500 * 15
    points = np.array([r.vector for r in rows.orderBy("id").collect()])
    d = np.sqrt(((points[:40, None, :] - points[None, :, :]) ** 2).sum(-1))
    want = {k: [m for m in np.lexsort((np.arange(1500), d[k])) if m != k][:15] for k in range(40)}
    got = {}
    for r in exact.where("id < 40").orderBy("id", "distance", "hit").collect():
        got.setdefault(r.id, []).append(r.hit)
    assert got == want
    found = N.knn_graph(rows, 15)
    assert found.groupBy("id").count().where("count <> 15").isEmpty()
    assert N.recall(found, exact) >= 0.95


def test_only_what_comes_into_a_full_list_leaves_a_task(spark):
    rng = np.random.default_rng(7)
    for matrix in (rng.normal(size=(60, 5)), rng.integers(0, 2, size=(60, 3)).astype(float), np.full((9, 2), 1e200) * rng.normal(size=(9, 2))):
        ids = rng.permutation(len(matrix)) * 3
        every = [(int(ids[a]), int(ids[b]), float(N.distances(matrix[a], matrix[b : b + 1])[0])) for a in range(len(ids)) for b in range(len(ids)) if a != b]
        nearest = {own: sorted((d, b) for a, b, d in every if a == own)[:7] for own in ids.tolist()}
        got = [tuple(r) for r in N.within(ids, matrix, 7).itertuples(index=False)]
        assert sorted(got) == sorted((a, b, d) for a, found in nearest.items() for d, b in found)
        reach = np.array([nearest[own][-1][0] if k % 5 else np.inf for k, own in enumerate(ids.tolist())])
        got = [tuple(r) for r in N.closer(ids, matrix, reach).itertuples(index=False)]
        assert sorted(got) == sorted(x for x in every if x[2] <= reach[ids.tolist().index(x[0])])
    assert len(N.within(np.array([4]), np.ones((1, 2)), 3)) == len(N.closer(np.array([4]), np.ones((1, 2)), np.ones(1))) == 0


def test_equal_vectors_share_leaves_of_bounded_size(spark):
    sizes = []
    rows = N.clean(table(spark, np.ones((700, 4))))

    def count(leaf):
        import pandas as pd

        yield pd.DataFrame({"id": [0], "hit": [len(leaf)], "distance": [0.0]})

    sizes = [r.hit for r in N.leaves(N.orders(rows, trees=2), count, N.EDGES, 100).collect()]
    assert sum(sizes) == 1400 and max(sizes) == 100


def test_packed_vectors_are_the_same_numbers(spark):
    rng = np.random.default_rng(2)
    floats = rng.normal(size=(40, 7)).astype(np.float32).astype(float)
    mixed = np.vstack([floats[:20], rng.normal(size=(20, 7)), np.zeros((1, 7)), np.full((1, 7), 1e200), np.full((1, 7), -0.0)])
    for points in (floats, mixed):
        rows = N.clean(table(spark, points)).coalesce(1)
        for cosine, plain in ((False, rows), (True, N.unit(rows))):
            got = N.packed(rows, cosine).toPandas().sort_values("id")
            want = np.stack([r.vector for r in plain.orderBy("id").collect()])
            assert np.array_equal(N.matrix_of(got["vector"]), want)
    assert set(N.packed(N.clean(table(spark, floats)), True).toPandas()["vector"].map(len)) == {8 + 4 * 7}


def test_neighbours_meet_in_blocks_unless_they_have_met(spark):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(60, 4))
    links = {(int(a), int(b)): bool(rng.random() < 0.3) for a in range(60) for b in rng.choice(60, 9, replace=False) if a != b}
    reach = rng.uniform(0.5, 3, 60)
    placed = N.packed(table(spark, points)).join(spark.createDataFrame([(k, float(x)) for k, x in enumerate(reach)], "id long, reach double"), "id").withColumnRenamed("id", "hit")
    seen = spark.createDataFrame([(a, b, new) for (a, b), new in links.items()], "id long, hit long, new boolean")
    want = set()
    for a, one in links:
        for b, other in links:
            if a == b and one != other and (links[a, one] or links[b, other]):
                d = float(N.distances(points[one], points[[other]])[0])
                want |= {(one, other, d)} if d <= reach[one] else set()
    for blocks in (1, 7):
        assert {tuple(r) for r in N._met(seen, placed, blocks).collect()} == want
    before = spark.createDataFrame([(1, 2, True), (3, 4, False)], "id long, hit long, new boolean")
    now = spark.createDataFrame([(1, 2), (1, 2), (5, 6)], "id long, hit long")
    assert {tuple(r) for r in N._links(now, before).collect()} == {(1, 2, False), (5, 6, True)}


def test_a_round_does_not_send_a_vector_to_each_neighbour(spark):
    def shuffled():
        jvm, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway
        jvm.listenerBus().waitUntilEmpty(60_000)
        stages = jvm.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(stages.apply(k).stageId(), stages.apply(k).attemptId()): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}

    points = np.random.default_rng(4).normal(size=(3000, 64)).astype(np.float32)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(points)], "id long, vector array<float>")
    before = shuffled()
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 48)
    try:
        found = density.density_clusters(rows, dense=0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert found.count() == 3000
    # 48 vectors of 512 bytes in three rounds alone are 74 kB a vector
    assert sum(v for k, v in shuffled().items() if k not in before) < 45_000 * 3000


def test_no_size_has_another_result(spark):
    """5,100 vectors by default; with ``most`` and ``dense`` as if there were too many: always the definition's clusters, of all vectors."""
    points = blobs(5100, seed=13)
    want = density.condensed(density.dense_tree(points, 10), len(points), 10)
    assert len(set(want.tolist())) > 4 and (want == -1).sum() > 50
    for given in ({}, {"most": 1000, "dense": 0}):
        found = labels_of(density.density_clusters(table(spark, points), cosine=False, **given), len(points))
        assert same_partition(found, want)
