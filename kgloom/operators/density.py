"""Density clusters with noise: mutual reachability, a minimum spanning tree, a condensed tree and the clusters of greatest stability. The result is that of the definition for every number of vectors, ties included.

* A vector's core distance is that to its ``least``-th neighbour, itself counted; two vectors' mutual reachability is the greatest of their distance and both cores. Both come from all pairs (``all_pairs``).
* The tree. A first one is that of each vector's nearest. Every task keeps the minimum spanning forest of its own edges, and forests are merged by ever fewer tasks: an edge that is not in the forest of a part is not in that of the whole.
  Where these edges leave several components, their vectors meet again in leaves of sorted projections, where only edges between components count, until one tree is left. Then all pairs are held against it: one that comes before the
  greatest edge of the tree between its two (by length, then ids) is missing, and the minimum spanning tree is that of the first tree's edges and the missing ones. How good the first tree is changes the work, not the result.
* Equal vectors are one in all that, with their number. Each further one has a single edge in the minimum spanning tree: to the least id among the first of its kind and those below it whose mutual reachability with it is its core.
* The condensed tree. Edges are taken away from the longest to the shortest; a part of under ``least`` vectors falls out, two larger ones are new clusters. A cluster's stability is the sum over its vectors of
  1 / (distance where the vector leaves) - 1 / (distance where the cluster began). Clusters whose stability is that of their children's sum or more stand, others give way; the whole is no cluster.

No size switches to another way and no vector is left to a sample. All pairs cost n * n / 2 distances twice, spread over all cores; the order of the tree and its condensing are one task each, of one small row a vector.

Defined cases: fewer than ``corpus`` vectors have no result, as in the survey's; equal vectors have distance 0 and stay together; noise is cluster -1; clusters are numbered by their least id; see ``neighbours.clean`` for nulls, repeats
and odd vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import staged, written
from . import all_pairs as P, neighbours as N
from .spanning import Sets, forest

LEAST, CORPUS, FANIN = 10, 20, 8
NOISE, ROOT = -1, 0
#: Distances under this one count as this one, so that equal vectors have a finite density.
SHORTEST = 1e-9
FOREST = "a long, b long, w double"


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forest of a task's edges: merged whenever as many edges wait as the forest has, so no more than twice the forest is held."""
    held, waiting = pd.DataFrame({"a": [], "b": [], "w": []}).astype({"a": "int64", "b": "int64"}), []
    for batch in batches:
        waiting.append(batch)
        if sum(map(len, waiting)) > max(len(held), 50_000):
            held, waiting = forest(pd.concat([held, *waiting])), []
    yield forest(pd.concat([held, *waiting]))


def spanning_forest(edges: DataFrame, put, parts: int) -> DataFrame:
    """Forests of ever fewer tasks, down to one."""
    while True:
        dealt = edges.repartition(parts, F.xxhash64("a", "b")) if parts > 1 else edges.coalesce(1)
        edges = put(dealt.mapInPandas(_forests, FOREST), "forest")
        if parts == 1:
            return edges
        parts = max(1, parts // FANIN)


def _components(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sets = Sets()
    for batch in batches:
        for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
            sets.join(a, b)
    ids = list(sets.up)
    yield pd.DataFrame({"id": ids, "component": [sets.root(x) for x in ids]})


def _links(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """Of a leaf: each vector's edge of least mutual reachability into another component."""
    ids, parts, cores, matrix = rows["id"].to_numpy(), rows["component"].to_numpy(), rows["core"].to_numpy(), N.matrix_of(rows["vector"])
    out = []
    for n, own in enumerate(ids):
        other = np.flatnonzero(parts != parts[n])
        if len(other):
            w = np.maximum(np.maximum(N.distances(matrix[n], matrix[other]), cores[other]), cores[n])
            m = other[np.lexsort((ids[other], w))[0]]
            out.append((int(min(own, ids[m])), int(max(own, ids[m])), float(w.min())))
    if out:
        yield pd.DataFrame(out, columns=["a", "b", "w"])


def core_distances(graph: DataFrame, least: int) -> DataFrame:
    """(id, core) from the nearest of each vector, where each stands for ``own`` or ``many`` equal ones."""
    seen = F.col("own") + F.sum("many").over(Window.partitionBy("id").orderBy("distance", "hit").rowsBetween(Window.unboundedPreceding, 0))
    reached = F.coalesce(F.min(F.when(F.col("seen") >= least, F.col("distance"))), F.max("distance"))
    return graph.withColumn("seen", seen).groupBy("id").agg(F.when(F.max("own") >= least, 0.0).otherwise(reached).alias("core"))


def spanning_tree(vectors: DataFrame, graph: DataFrame, cores: DataFrame, n: int, put, seed: int = N.SEED) -> DataFrame:
    """(a, b, w), the edges of a spanning tree of ``n`` vectors that is short by mutual reachability: the least one of the pairs of ``graph`` and of those that met in leaves."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    core = lambda name: cores.select(F.col("id").alias(name), F.col("core").alias(f"core_{name}"))
    pairs = graph.select(F.least("id", "hit").alias("a"), F.greatest("id", "hit").alias("b"), "distance").distinct()
    edges = pairs.join(core("a"), "a").join(core("b"), "b").select("a", "b", F.greatest("distance", "core_a", "core_b").alias("w"))
    tree, turn = spanning_forest(edges, put, parts), 0
    while (found := tree.count()) < n - 1:
        labels = put(tree.coalesce(1).mapInPandas(_components, "id long, component long"), "components")  # a small row a vector
        marked = vectors.join(labels, "id", "left").join(cores, "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.coalesce("core", F.lit(0.0)).alias("core"))
        ordered = N.orders(vectors, seed=seed + 1 + turn).join(marked, "id")
        # another order with larger leaves and fewer borders each time: components that no leaf holds together meet at last
        links = N.leaves(ordered, _links, FOREST, N.LEAF << min(turn, 6), ("component", "core"), max(1, parts >> turn))
        tree, turn = spanning_forest(tree.unionByName(links.distinct()), put, parts), turn + 1
        if turn > 64:
            raise RuntimeError(f"{n - found} components stay apart")
    return tree


def _path(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A tree's vectors in a row. Two parts that an edge joins, from the least edge on, are put behind each other, and the step between them is the edge: so the greatest edge between two vectors is the greatest step between their places."""
    edges = pd.concat([pd.DataFrame({"a": [], "b": [], "w": []}), *batches]).astype({"a": "int64", "b": "int64"}).sort_values(["w", "a", "b"], kind="stable")
    if not len(edges):
        return
    ids, ends = np.unique(np.concatenate([edges["a"], edges["b"]]), return_inverse=True)
    n, m = len(ids), len(edges)
    up, last, behind, step = list(range(n)), list(range(n)), [-1] * n, np.full(n, -1)

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    size = [1] * n
    head = list(range(n))  # of the part of a root
    for k, (a, b) in enumerate(zip(ends[:m].tolist(), ends[m:].tolist())):
        a, b = root(a), root(b)
        behind[last[a]], step[last[a]] = head[b], k
        first, end = head[a], last[b]
        if size[a] < size[b]:
            a, b = b, a
        up[b], size[a], head[a], last[a] = a, size[a] + size[b], first, end
    order, at = np.empty(n, dtype=np.int64), head[root(0)]
    for place in range(n):
        order[place], at = at, behind[at]
    taken = edges.iloc[step[order]].reset_index(drop=True)  # the last of the row has no step
    taken.loc[n - 1, "w"] = -1.0
    yield pd.DataFrame({"id": ids[order], "place": np.arange(n), "w": taken["w"], "a": taken["a"], "b": taken["b"]})


def dense_tree(matrix: np.ndarray, least: int) -> list[tuple[float, int, int]]:
    """The minimum spanning tree of all pairs by mutual reachability, ties by places, edge by edge from the first vector on: rows of the matrix of distances are made when they are needed. For tests: one process walks through all pairs."""
    n = len(matrix)
    core = np.array([np.partition(N.distances(v, matrix), min(least, n) - 1)[min(least, n) - 1] for v in matrix])
    best, low, high = np.full(n, np.inf), np.full(n, n), np.full(n, n)
    out, waits, last = [], np.ones(n, dtype=bool), 0
    for _ in range(n - 1):
        waits[last] = False
        rest = np.flatnonzero(waits)
        w = np.maximum(np.maximum(N.distances(matrix[last], matrix[rest]), core[rest]), core[last])
        a, b = np.minimum(rest, last), np.maximum(rest, last)
        less = (w < best[rest]) | ((w == best[rest]) & ((a < low[rest]) | ((a == low[rest]) & (b < high[rest]))))
        best[rest[less]], low[rest[less]], high[rest[less]] = w[less], a[less], b[less]
        least_w = rest[best[rest] == best[rest].min()]
        last = int(least_w[np.lexsort((high[least_w], low[least_w]))[0]])
        out.append((float(best[last]), int(low[last]), int(high[last])))
    return sorted(out)


def condensed(edges: list[tuple[float, int, int]], n: int, least: int) -> np.ndarray:
    """The label of each of n vectors from the n - 1 edges (w, a, b) of their tree, in rising order of w."""
    # the dendrogram: node n + k joins two nodes at edge k
    up, size, children, height = list(range(2 * n - 1)), [1] * n + [0] * (n - 1), [], []

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for k, (w, a, b) in enumerate(edges):
        left, right = root(a), root(b)
        up[left] = up[right] = n + k
        size[n + k] = size[left] + size[right]
        children.append((left, right))
        height.append(max(w, SHORTEST))
    parent, birth, stability, own = [-1], [0.0], [0.0], np.zeros(n, dtype=np.int64)
    below: list[list[int]] = [[]]
    stack = [(2 * n - 2, ROOT)]
    while stack:
        node, cluster = stack.pop()
        density = 1 / height[node - n]
        large = [c for c in children[node - n] if size[c] >= least]
        for child in children[node - n]:
            if len(large) == 2:
                stability[cluster] += size[child] * (density - birth[cluster])
                parent.append(cluster)
                birth.append(density)
                stability.append(0.0)
                below.append([])
                below[cluster].append(len(parent) - 1)
                if child >= n:
                    stack.append((child, len(parent) - 1))
                else:
                    own[child] = len(parent) - 1
            elif size[child] >= least:
                stack.append((child, cluster))
            else:
                stability[cluster] += size[child] * (density - birth[cluster])
                left = [child]
                while left:
                    x = left.pop()
                    if x < n:
                        own[x] = cluster
                    else:
                        left += children[x - n]
    stands = [False] * len(parent)
    for c in range(len(parent) - 1, ROOT, -1):
        beneath = sum(stability[x] for x in below[c])
        stands[c] = stability[c] >= beneath
        stability[c] = max(stability[c], beneath)
    named = [NOISE] * len(parent)
    for c in range(1, len(parent)):
        named[c] = named[parent[c]] if named[parent[c]] != NOISE else c if stands[c] else NOISE
    return np.array(named)[own]


def _labels(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = pd.concat([pd.DataFrame({"a": [], "b": [], "w": []}), *batches]).astype({"a": "int64", "b": "int64"}).sort_values(["w", "a", "b"], kind="stable")
        if not len(edges):
            return
        ids, places = np.unique(np.concatenate([edges["a"], edges["b"]]), return_inverse=True)
        m = len(edges)
        found = condensed(list(zip(edges["w"].tolist(), places[:m].tolist(), places[m:].tolist())), len(ids), least)
        first: dict[int, int] = {}
        for label in found.tolist():  # ids rise, so the first of a cluster is its least
            if label != NOISE:
                first.setdefault(label, len(first))
        yield pd.DataFrame({"id": ids, "cluster": [first.get(x, NOISE) for x in found.tolist()]})

    return run


def _keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Equal numbers have equal keys, however they are packed."""
    for batch in batches:
        if len(batch):
            yield batch.assign(key=[hashlib.blake2b(v.tobytes(), digest_size=16).digest() for v in N.matrix_of(batch["vector"]) + 0.0])  # no -0.0


def least_tree(vectors: DataFrame, n: int, least: int, k: int, put) -> DataFrame:
    """(a, b, w), the minimum spanning tree of ``n`` packed vectors by mutual reachability, ties by a and b."""
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = put(vectors.mapInPandas(_keys, "id long, vector binary, key binary"), "keys")
    kinds = put(held.groupBy("key").agg(F.min_by("vector", "id").alias("vector"), F.min("id").alias("id"), F.count("*").alias("many")), "kinds")
    once = kinds.select("id", "vector", "many")
    m = kinds.count()
    groups = P.groups_of(kinds, m)
    graph = put(P.nearest(once, max(1, k), groups), "nearest")
    cores = put(core_distances(graph, least), "cores")
    tree = spanning_tree(once.select("id", "vector"), graph, cores, m, put)
    path = put(tree.coalesce(1).mapInPandas(_path, "id long, place long, w double, a long, b long"), "path")  # a small row a vector
    found = put(P.shorter(once.join(cores, "id"), path, m, groups), "shorter")
    missing = found.where(F.col("kind") == P.EDGE).select("a", "b", "w")
    if not missing.isEmpty():
        tree = spanning_forest(tree.unionByName(missing), put, parts)
    if m == n:
        return tree
    firsts = found.where(F.col("kind") == P.FIRST).groupBy(F.col("a").alias("first")).agg(F.min("b").alias("b"))
    copied = kinds.where("many > 1").select("key", F.col("id").alias("first")).join(firsts, "first", "left").join(cores.withColumnRenamed("id", "first"), "first", "left")
    copies = held.select("id", "key").join(copied.select("key", "first", F.coalesce("b", "first").alias("a"), F.coalesce("core", F.lit(0.0)).alias("w")), "key").where("id <> first")
    return tree.unionByName(copies.select("a", F.col("id").alias("b"), "w"))


def density_clusters(vectors: DataFrame, least: int = LEAST, k: int = N.POOL, corpus: int = CORPUS, most: int | None = None, dense: int | None = None, cosine: bool = True) -> DataFrame:
    """(id, cluster) for every vector of ``vectors`` (id, vector). Stored until the session ends.

    ``k``, ``most`` and ``dense`` change nothing any more: the number of neighbours, the sample and the size up to which it was exact, of a way that was not. They are taken from callers that still name them.
    """
    spark = vectors.sparkSession
    rows = N.clean(vectors)
    with staged(spark) as put:
        held = put(N.packed(rows, cosine), "held")
        n = held.count()
        if n < max(2, corpus):
            return spark.createDataFrame([], "id long, cluster long")
        tree = least_tree(held, n, least, least - 1, put)
        return written(tree.coalesce(1).mapInPandas(_labels(least), "id long, cluster long"), "clusters")  # a small row a vector
