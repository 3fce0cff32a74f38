"""The vector index: all lists give the exact result, few lists read few files and find most of it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.operators import neighbours as N, vector_index as V


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(12)
    middle = rng.normal(size=(30, 24))
    points = middle[rng.integers(0, 30, 1800)] + rng.normal(size=(1800, 24)) * 0.35
    points[100:130] = points[99]  # equal vectors tie
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(points)], "id long, vector array<double>")


@pytest.fixture(scope="module")
def index(vectors):
    made = V.build(vectors)
    yield made
    made.drop()


def plain(vectors, k):
    rows = sorted((r.id, r.vector) for r in vectors.collect())
    points = np.array([v for _, v in rows])
    points = points / np.sqrt((points**2).sum(axis=1))[:, None]
    out = {}
    for q in range(0, len(points), 20):
        d = np.sqrt(((points - points[q]) ** 2).sum(axis=1))
        out[q] = [m for m in np.lexsort((np.arange(len(d)), d.round(12))) if m != q][:k]
    return out


def hits(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.id, round(r.distance, 12), r.hit)):
        out.setdefault(r.id, []).append(r.hit)
    return out


def test_all_lists_are_exact(vectors, index):
    assert index.lists == 42 and index.rows.count() == 1800
    assert hits(index.search(vectors.where("id % 20 = 0"), 10, index.lists)) == plain(vectors, 10)


def test_few_lists_find_most(vectors, index):
    want, got = plain(vectors, 10), hits(index.search(vectors.where("id % 20 = 0"), 10, 8))
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert np.mean([len(set(want[q]) & set(got[q])) / 10 for q in want]) >= 0.9


def test_files_read_fall_with_the_probes(spark, vectors, index):
    import re

    def read(probes):
        found = index.search(vectors.where("id = 40"), 5, probes)
        plan = found._jdf.queryExecution().toString()
        assert re.search(r"PartitionFilters: \[[^\]]*list#\d+", plan)
        near = np.argsort(V._to_lists(np.array(N.unit(N.clean(vectors.where("id = 40"))).first().vector)[None], index.centroids)[0])[:probes]
        return len(index.rows.where(F.col("list").isin([int(x) for x in near])).select(F.input_file_name()).distinct().collect())

    assert read(1) < read(6) < read(20) < read(index.lists)


def test_codes_are_read_without_vectors(vectors, index):
    plan = index.search(vectors.where("id = 40"), 5, 3)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<id:bigint,code:binary,scale:double>" in plan


def test_odd_tables(spark, index, vectors):
    none = V.build(spark.createDataFrame([], "id long, vector array<double>"))
    assert none.lists == 0 and none.search(vectors, 3).count() == 0
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (None, [1.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, 0.0]), (4, [2.0, 0.0]), (5, [1.0])], "id long, vector array<double>")
    small = V.build(odd.withColumn("list", F.lit("x")))
    assert sorted(r.id for r in small.rows.collect()) == [1, 4]
    assert hits(small.search(odd.where("id = 4"), 5, 9)) == {4: [1]}
    assert index.search(odd.where("id = 4"), 5).count() == 0  # another width
    same = V.build(spark.createDataFrame([(k, [1.0, 1.0]) for k in range(50)], "id long, vector array<double>"), lists=5)
    assert hits(same.search(spark.createDataFrame([(7, [1.0, 1.0])], "id long, vector array<double>"), 3, same.lists)) == {7: [0, 1, 2]}


def test_many_queries_go_in_blocks(vectors, index, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 17)
    assert hits(index.search(vectors.where("id % 20 = 0"), 10, index.lists)) == plain(vectors, 10)


def test_probes_are_measured(spark):
    points = np.random.default_rng(3).normal(size=(1500, 24))  # no clusters: eight lists would not do
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(points)], "id long, vector array<double>")
    index, asked = V.build(rows), rows.where("id % 20 = 0")
    probes = index.probes_for(asked)
    want, got = plain(rows, 10), hits(index.search(asked, 10, probes))
    assert 8 < probes < index.lists
    assert np.mean([len(set(want[q]) & set(got[q])) / 10 for q in want]) >= 0.9
    index.drop()


def test_a_scan_gives_its_hits_on_in_small_frames(monkeypatch):
    import types

    import pandas as pd

    monkeypatch.setattr(V, "OUT_ROWS", 50)
    rng = np.random.default_rng(2)
    matrix, vectors = rng.normal(size=(30, 4)), rng.normal(size=(40, 4))
    held = types.SimpleNamespace(value=(np.arange(30), matrix, {n: list(range(30)) for n in range(4)}, np.zeros((4, 4))))
    batch = pd.DataFrame({"list": np.repeat(np.arange(4), 10), "id": np.arange(40), "vector": list(vectors)})
    frames = list(V._scan(held, 5, lambda rows, c: np.stack(rows["vector"].to_numpy()), True)(iter([batch])))
    assert max(map(len, frames)) < 50 + 5 and len(frames) > 8
    got = {(r.id, r.list): [] for f in frames for r in f.itertuples()}
    for f in frames:
        for r in f.itertuples():
            got[r.id, r.list].append(r.hit)
    for q in range(30):
        for n in range(4):
            d = [(float(np.sqrt(((matrix[q] - vectors[m]) ** 2).sum())), m) for m in range(n * 10, n * 10 + 10) if m != q]
            assert got[q, n] == [m for _, m in sorted(d)[:5]]
