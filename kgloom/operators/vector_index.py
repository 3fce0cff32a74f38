"""An index of vectors by inverted lists: coarse centroids, a stored partition for each list, residual codes, and exact scores for the best.

* ``build`` learns centroids from at most ``SAMPLE`` vectors, a documented bound, and writes every vector to the list of its nearest centroid: a folder for each list, with the vector, and its residual in signed
  bytes and a scale. A list of many rows is written by several tasks.
* ``search`` takes the ``probes`` nearest lists of each query, so that only their folders are read. Codes alone are read first and give ``WIDER`` times k candidates; the vectors of these are then scored exactly. With all lists probed
  every vector is scored exactly, so the result is that of a full scan.

How many probes a table needs depends on how its vectors lie: ``probes_for`` measures it on a sample of the queries.

A query costs its probes, not the table: with the default of about sqrt(n) lists a probe is about sqrt(n) rows. Queries are a stated set, held in blocks of ``BLOCK``; what is broadcast is a block and the centroids, whose
size ``build`` bounds. Distances are Euclidean over vectors of length 1, so the order is that of the cosine.

Defined cases: see ``neighbours.clean`` for nulls, repeats and odd vectors; a query does not find itself; ties go to the lesser id; queries of another width find nothing; an empty table gives an index without rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import remove, shared_folder
from . import neighbours as N

SAMPLE, TURNS, WIDER, BLOCK, FILE_ROWS, SEED = 50_000, 12, 4, 1000, 100_000, 42
#: Hits that a task holds before it gives them on.
OUT_ROWS = 20_000
#: Centroids are broadcast: 64 MB at most.
CENTROID_BYTES = 64 << 20
ROWS = "list int, id long, code binary, scale double, vector array<double>"


def _to_lists(matrix: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances up to each row's own length."""
    return (centroids**2).sum(axis=1) - 2 * matrix @ centroids.T


def learn_centroids(sample: np.ndarray, lists: int, turns: int = TURNS, seed: int = SEED) -> np.ndarray:
    """Means of the nearest, turn by turn, from a seeded choice; a list that loses all its rows takes the row that is farthest from its own."""
    rng = np.random.default_rng(seed)
    centroids = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(turns):
        away = np.concatenate([_to_lists(part, centroids) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        own = away.argmin(axis=1)
        counts = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        spare = iter(np.argsort(-(away.min(axis=1) + (sample**2).sum(axis=1)), kind="stable"))
        centroids = np.stack([sums[k] / counts[k] if counts[k] else sample[next(spare)] for k in range(lists)])
    return centroids


@dataclass
class VectorIndex:
    """A stored index; ``drop`` removes it."""

    spark: SparkSession
    path: str
    centroids: np.ndarray

    @property
    def lists(self) -> int:
        return len(self.centroids)

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema("id long, code binary, scale double, vector array<double>, list int").parquet(f"{self.path}/lists")

    def drop(self) -> None:
        remove(self.spark, self.path)

    def probes_for(self, queries: DataFrame, k: int = 10, share: float = 0.95, sample: int = 64) -> int:
        """The least number of probes with which a sample of the queries finds that share of its exact k nearest: how far down each query's order of lists they lie."""
        asked = N.unit(N.clean(queries)).orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
        if not len(asked) or not self.lists or len(asked["vector"].iloc[0]) != self.centroids.shape[1]:
            return max(1, self.lists)
        order = np.argsort(_to_lists(np.stack(asked["vector"].to_numpy()), self.centroids), axis=1, kind="stable")
        depth = {int(q): np.argsort(lists) for q, lists in zip(asked["id"], order)}
        found = self._block(asked["id"].to_numpy(), np.stack(asked["vector"].to_numpy()), k, self.lists)
        hits = found.join(self.rows.select(F.col("id").alias("hit"), "list"), "hit").select("id", "list").collect()  # sample * k rows
        deep = sorted(int(depth[r["id"]][r["list"]]) + 1 for r in hits)
        return deep[min(len(deep) - 1, math.ceil(share * len(deep)))] if deep else 1

    def search(self, queries: DataFrame, k: int = 10, probes: int = 8) -> DataFrame:
        """(id, hit, distance): about the k nearest of each query (id, vector), all of them with every list probed."""
        asked = N.unit(N.clean(queries))
        blocks = max(1, -(-asked.count() // BLOCK))
        out = None
        for block in range(blocks):
            some = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toPandas()  # about BLOCK queries
            if len(some) and self.lists and len(some["vector"].iloc[0]) == self.centroids.shape[1]:
                one = self._block(some["id"].to_numpy(), np.stack(some["vector"].to_numpy()), k, min(probes, self.lists))
                out = one if out is None else out.unionByName(one)
        return self.spark.createDataFrame([], N.EDGES) if out is None else out

    def _block(self, ids: np.ndarray, matrix: np.ndarray, k: int, probes: int) -> DataFrame:
        near = np.argsort(_to_lists(matrix, self.centroids), axis=1, kind="stable")[:, :probes]
        asks: dict[int, list[int]] = {}
        for q, own in enumerate(near.tolist()):
            for number in own:
                asks.setdefault(number, []).append(q)
        held = self.spark.sparkContext.broadcast((ids, matrix, asks, self.centroids))
        read = self.rows.where(F.col("list").isin(list(asks)))
        if probes == self.lists:
            return N.nearest(read.select("list", "id", "vector").mapInPandas(_scan(held, k, lambda rows, c: np.stack(rows["vector"].to_numpy())), N.EDGES), k)

        def decoded(rows: pd.DataFrame, centroid: np.ndarray) -> np.ndarray:
            codes = np.stack([np.frombuffer(c, dtype=np.int8) for c in rows["code"]]).astype(float)
            return centroid + codes * rows["scale"].to_numpy()[:, None]

        found = N.nearest(read.select("list", "id", "code", "scale").mapInPandas(_scan(held, WIDER * k, decoded, True), f"{N.EDGES}, list int"), WIDER * k)
        # the vectors of the candidates alone: their lists are read again, without the codes
        vectors = read.select(F.col("list").alias("in"), F.col("id").alias("hit"), "vector")
        pairs = vectors.join(found.select("id", "hit", F.col("list").alias("in")), ["in", "hit"])
        return N.nearest(pairs.select("id", "hit", "vector").mapInPandas(_exact(held), N.EDGES), k)


def _scan(held, k: int, of, with_list: bool = False):
    """Of each batch the k nearest to each query that asks for its lists, given on in frames of about ``OUT_ROWS``: what a task holds doesn't grow with queries and lists."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix, asks, centroids = held.value
        for batch in batches:
            for number, rows in batch.groupby("list", sort=False):
                found, held_rows = [], 0
                hits, vectors = rows["id"].to_numpy(), of(rows, centroids[number])
                for q in asks[number]:
                    d = N.distances(matrix[q], vectors)
                    first = np.argpartition(d, k)[: k + 1] if len(d) > k + 1 else np.arange(len(d))
                    first = np.flatnonzero(d <= d[first].max())  # with all that tie
                    order = first[np.lexsort((hits[first], d[first]))][: k + 1]
                    order = order[hits[order] != ids[q]][:k]
                    found.append((np.full(len(order), ids[q]), hits[order], d[order]))
                    held_rows += len(order)
                    if held_rows >= OUT_ROWS:
                        yield framed(found, number)
                        found, held_rows = [], 0
                if found:
                    yield framed(found, number)

    def framed(found: list, number: int) -> pd.DataFrame:
        own, hits, d = (np.concatenate(x) for x in zip(*found))
        frame = pd.DataFrame({"id": own, "hit": hits, "distance": d})
        return frame.assign(list=np.int32(number)) if with_list else frame

    return run


def _exact(held):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, matrix, _, _ = held.value
        place = {int(x): n for n, x in enumerate(ids)}
        for batch in batches:
            d = [float(N.distances(np.asarray(v), matrix[[place[q]]])[0]) for q, v in zip(batch["id"], batch["vector"])]
            yield pd.DataFrame({"id": batch["id"], "hit": batch["hit"], "distance": d})

    return run


def build(vectors: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = SEED) -> VectorIndex:
    """The index of ``vectors`` (id, vector) in the shared folder."""
    spark = vectors.sparkSession
    rows = N.unit(N.clean(vectors))
    n = rows.count()
    learn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).toPandas()
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    if not n:
        spark.createDataFrame([], ROWS).write.partitionBy("list").parquet(f"{path}/lists")
        return VectorIndex(spark, path, np.zeros((0, 0)))
    matrix = np.stack(learn["vector"].to_numpy())
    most = max(1, CENTROID_BYTES // (8 * matrix.shape[1]))
    lists = max(1, min(lists or round(math.sqrt(n)), len(matrix), most))
    held = spark.sparkContext.broadcast(learn_centroids(matrix, lists, seed=seed))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            own = np.stack(batch["vector"].to_numpy())
            number = _to_lists(own, held.value).argmin(axis=1)
            rest = own - held.value[number]
            scale = np.maximum(np.abs(rest).max(axis=1), 1e-12) / 127
            codes = np.rint(rest / scale[:, None]).astype(np.int8)
            yield pd.DataFrame({"list": number.astype(np.int32), "id": batch["id"], "code": [c.tobytes() for c in codes], "scale": scale, "vector": batch["vector"]})

    listed = rows.mapInPandas(run, ROWS)
    # a list of many rows is dealt to several tasks
    parts = max(1, -(-n // FILE_ROWS))
    dealt = listed.repartition("list", F.pmod(F.xxhash64("id"), F.lit(parts)))
    dealt.write.partitionBy("list").parquet(f"{path}/lists")
    return VectorIndex(spark, path, held.value)
