"""Nearest neighbours of every vector of a table: an approximate graph from sorted random projections and rounds of neighbours' neighbours, and an exact one in blocks.

Each of ``TREES`` orders sorts all vectors by the signs of random projections of the centred vectors, then by one more projection. Vectors that are close tend to be close in an order, so it is cut into
leaves of ``LEAF`` rows, however many vectors are equal, and only the rows of a leaf are compared. A round of descent then compares the neighbours of each vector, either way and at most ``POOL`` each, with
each other; the best ``POOL`` of a vector are kept until the last round, and only what can come among these leaves a task. The work for a row is that of its leaves and rounds and doesn't depend on the table's size. The exact graph holds blocks of the table against all of it and is meant for small
tables, tests and measures of recall.

In a round the vectors whose neighbours are compared are dealt into blocks, and a vector goes once to a block, with all those there that it is a neighbour of, not once to each of them. There are as many blocks as cores, and more
where a block's vectors would take over ``BLOCK_BYTES``; a vector is never sent more often than it has neighbours. Two that a vector had as neighbours a round before have met and are not compared again. Vectors travel packed: as floats where these are their numbers.

Distances are Euclidean; vectors of length 1 are thus compared by cosine. Rows without an id, a vector or a number in it, or with another width than the first row by id have no neighbours; of repeated ids the vector
that is first by value counts; ties go to the lesser id; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import staged, written

TREES, LEAF, POOL, ROUNDS, DEPTH, SEED = 6, 128, 48, 3, 24, 42
#: Vectors of one block of a round, at most.
BLOCK_BYTES = 1 << 29
EDGES = "id long, hit long, distance double"


def clean(vectors: DataFrame, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(id, vector): one finite vector of the table's width for each id."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id IS NOT NULL AND vector IS NOT NULL")
    finite = rows.where(~F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    first = finite.groupBy("id").agg(F.min("vector").alias("vector"))
    width = finite.agg(F.min_by(F.size("vector"), F.struct("id", "vector")).alias("n")).first()["n"]
    return first.where(F.size("vector") == (width or 0))


def unit(vectors: DataFrame) -> DataFrame:
    """Vectors of length 1; those without a length stay as they are."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return vectors.withColumn("_n", norm).withColumn("vector", F.when(F.col("_n") > 0, F.transform("vector", lambda x: x / F.col("_n"))).otherwise(F.col("vector"))).drop("_n")


def packed(rows: DataFrame, cosine: bool = False) -> DataFrame:
    """(id, vector) with a vector as bytes: what its numbers are divided by (below zero if the numbers are doubles), then the numbers, as floats if these are the same. ``cosine``: as ``unit`` makes them."""
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)) if cosine else F.lit(0.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for vector, by in zip(batch["vector"], batch["by"]):
                with np.errstate(over="ignore"):
                    short = vector.astype(np.float32)
                same = bool((short == vector).all())
                by = by if by > 0 else 1.0
                out.append(np.float64(by if same else -by).tobytes() + (short if same else vector).tobytes())
            yield pd.DataFrame({"id": batch["id"], "vector": out})

    return rows.select("id", "vector", norm.alias("by")).mapInPandas(run, "id long, vector binary")


def opened(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Packed vectors as a matrix of their numbers and a column that these are to be divided by."""
    sizes = vectors.str.len().to_numpy()
    parts, places = [], []
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        raw = np.frombuffer(b"".join(vectors.iloc[at]), np.uint8).reshape(len(at), size)
        by = raw[:, :8].copy().view(np.float64)
        parts.append((raw[:, 8:].copy().view(np.float32 if by[0, 0] > 0 else np.float64), np.abs(by)))
        places.append(at)
    back = np.argsort(np.concatenate(places))
    return tuple(np.concatenate(x)[back] for x in zip(*parts))


def matrix_of(vectors: pd.Series) -> np.ndarray:
    """Vectors, packed or as arrays, as the rows of a matrix."""
    if isinstance(vectors.iloc[0], bytes):
        numbers, by = opened(vectors)
        return numbers / by
    return np.stack(vectors.to_numpy())


def distances(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of a vector to others, the same for a pair in any company."""
    return np.sqrt(((many - one) ** 2).sum(axis=1))


def _rough(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of all pairs by one product of matrices, those to themselves infinite, and by how much they may be wrong."""
    with np.errstate(over="ignore", invalid="ignore"):
        size = (matrix**2).sum(axis=1)
        rough = size[:, None] + size[None, :] - 2 * (matrix @ matrix.T)
        slack = 1e-9 * (size[:, None] + size.max())
    if not np.isfinite(rough).all():  # lengths too great to be squared: every pair is worked out
        rough = np.zeros_like(rough)
    np.fill_diagonal(rough, np.inf)
    return rough, slack


def _worked_out(ids: np.ndarray, matrix: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and exact distances of the pairs wanted, by the first, the distance and the other's id."""
    one, other = np.nonzero(wanted)
    step = max(1, (1 << 20) // matrix.shape[1])
    d = np.concatenate([np.zeros(0), *(distances(matrix[one[k : k + step]], matrix[other[k : k + step]]) for k in range(0, len(one), step))])
    order = np.lexsort((ids[other], d, one))
    return one[order], other[order], d[order]


def within(ids: np.ndarray, matrix: np.ndarray, k: int) -> pd.DataFrame:
    """Each row's k nearest among the others, ties to the lesser id."""
    if len(ids) < 2:
        return _frame([], [], [])
    rough, slack = _rough(matrix)
    last = np.partition(rough, k - 1, axis=1)[:, k - 1 : k] if k < len(ids) - 1 else np.inf
    one, other, d = _worked_out(ids, matrix, rough <= np.minimum(last + 2 * slack, np.finfo(float).max))
    rank = np.arange(len(one)) - np.searchsorted(one, one)
    keep = rank < k
    return _frame(ids[one[keep]], ids[other[keep]], d[keep])


def closer(ids: np.ndarray, matrix: np.ndarray, reach: np.ndarray, new: np.ndarray | None = None) -> pd.DataFrame:
    """Of each row the others that are no farther than its ``reach``; with ``new``, pairs of which one row at least is new."""
    if len(ids) < 2 or new is not None and not new.any():
        return _frame([], [], [])
    rough, slack = _rough(matrix)
    with np.errstate(over="ignore"):
        wanted = rough <= np.minimum((reach**2)[:, None] * (1 + 1e-9) + 2 * slack, np.finfo(float).max)
    if new is not None:
        wanted &= new[:, None] | new[None, :]
    one, other, d = _worked_out(ids, matrix, wanted)
    keep = d <= reach[one]
    return _frame(ids[one[keep]], ids[other[keep]], d[keep])


def _frame(ids, hits, d) -> pd.DataFrame:
    return pd.DataFrame({"id": np.asarray(ids, dtype=np.int64), "hit": np.asarray(hits, dtype=np.int64), "distance": np.asarray(d, dtype=float)})


def nearest(edges: DataFrame, k: int, key: str = "id", other: str = "hit") -> DataFrame:
    """The k least edges of each key: ranks are cut in each task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy("distance", other))
    return edges.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def _best(edges: DataFrame, k: int) -> DataFrame:
    """The k least edges of each id, repeated ones once, in one shuffle."""
    return nearest(edges.repartition("id").distinct(), k)


def orders(vectors: DataFrame, trees: int = TREES, seed: int = SEED) -> DataFrame:
    """Every vector, packed or not, once for each tree, with its place in that tree's order: tree, signs and value."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total = 0, 0.0
        for batch in batches:
            if len(batch):
                n, total = n + len(batch), total + matrix_of(batch["vector"]).sum(axis=0)
        if n:
            yield pd.DataFrame({"n": [n], "total": [total]})

    found = vectors.select("vector").mapInPandas(sums, "n long, total array<double>").collect()  # one vector a task
    mean = np.sum([r["total"] for r in found], axis=0) / max(1, sum(r["n"] for r in found))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        planes = np.random.default_rng(seed).normal(size=(trees, DEPTH + 1, mean.size))
        for batch in batches:
            if not len(batch):
                continue
            centred = matrix_of(batch["vector"]) - mean
            for tree in range(trees):
                seen = centred @ planes[tree].T
                signs = (seen[:, :-1] > 0) @ (1 << np.arange(DEPTH - 1, -1, -1))
                yield batch.assign(tree=tree, signs=signs, value=seen[:, -1])

    kind = vectors.schema["vector"].dataType.simpleString()
    return vectors.select("id", "vector").mapInPandas(run, f"id long, vector {kind}, tree int, signs long, value double")


def leaves(ordered: DataFrame, compare, schema: str, leaf: int = LEAF, extra: tuple[str, ...] = (), parts: int | None = None) -> DataFrame:
    """``compare`` of the rows of each leaf: runs of at most ``leaf`` rows of a tree's order. Every partition is cut for itself, so no run is gathered from several."""
    spark = ordered.sparkSession
    place = ["tree", "signs", "value", "id"]
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            tree, at = held["tree"].to_numpy(), 0
            while at < len(held):
                n = min(leaf, int(np.searchsorted(tree, tree[at], "right")) - at)
                if at + n == len(held) and n < leaf:
                    break  # the run may go on in the next batch
                yield from compare(held.iloc[at : at + n])
                at += n
            held = held.iloc[at:].reset_index(drop=True)
        if held is not None and len(held):
            yield from compare(held)

    return ordered.select(*place, "vector", *extra).repartitionByRange(parts, *place).sortWithinPartitions(*place).mapInPandas(run, schema)


def knn_graph(vectors: DataFrame, k: int = 15, trees: int = TREES, leaf: int = LEAF, pool: int = POOL, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """(id, hit, distance): about the k nearest of every vector. ``vectors`` as from ``clean`` or ``packed``. Stored until the session ends."""
    spark, pool = vectors.sparkSession, max(k, pool)
    with staged(spark) as put:
        held = put(vectors.select("id", "vector") if dict(vectors.dtypes)["vector"] == "binary" else packed(vectors), "vectors")
        size = held.agg(F.sum(F.length("vector")).alias("n")).first()["n"] or 0
        blocks = max(1, spark.sparkContext.defaultParallelism, -(-size * pool // BLOCK_BYTES))

        def compare(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            yield within(rows["id"].to_numpy(), matrix_of(rows["vector"]), pool)

        graph = put(_best(leaves(orders(held, trees, seed), compare, EDGES, max(leaf, k + 1)), pool), "graph")
        links = None
        for turn in range(rounds):
            back = nearest(graph, pool, "hit", "id").select(F.col("hit").alias("id"), F.col("id").alias("hit"))
            # what is farther from a vector than the last of its full list can't come into it
            reach = graph.groupBy("id").agg(F.when(F.count("*") >= pool, F.max("distance")).otherwise(float("inf")).alias("reach"))
            placed = held.join(reach, "id", "left").select(F.col("id").alias("hit"), "vector", F.coalesce("reach", F.lit(float("inf"))).alias("reach"))
            links = _links(graph.select("id", "hit").unionByName(back), links)
            links = put(links, "links") if turn < rounds - 1 else links
            graph = put(_best(graph.unionByName(_met(links, placed, blocks)), pool), "graph")
        return written(graph if k == pool else nearest(graph, k), "knn")


def _links(seen: DataFrame, before: DataFrame | None) -> DataFrame:
    """(id, hit, new), each pair once: new if it is not one of ``before``."""
    marked = seen.withColumn("now", F.lit(True))
    if before is not None:
        marked = marked.unionByName(before.select("id", "hit", F.lit(False).alias("now")))
    once = marked.repartition("hit").groupBy("id", "hit").agg(F.max("now").alias("now"), F.min("now").alias("new"))
    return once.where("now").select("id", "hit", "new")


def _met(links: DataFrame, placed: DataFrame, blocks: int) -> DataFrame:
    """What the neighbours of each vector are to each other, as far as it is in reach and one of them is new."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(b["hit"].to_numpy(), b["reach"].to_numpy(), *opened(b["vector"]), b["new"].str.len().to_numpy(), b["old"].str.len().to_numpy(), np.concatenate(b["new"].to_numpy()), np.concatenate(b["old"].to_numpy())) for b in batches if len(b)]
        if not rows:
            return
        hits, reach, numbers, by, n_new, n_old, new, old = (np.concatenate(x) for x in zip(*rows))
        del rows
        every = np.arange(len(hits))
        ids, at, fresh = np.concatenate([new, old]), np.concatenate([np.repeat(every, n_new), np.repeat(every, n_old)]), np.arange(len(new) + len(old)) < len(new)
        order = np.argsort(ids, kind="stable")
        ids, at, fresh = ids[order], at[order], fresh[order]
        ends = [*(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        out = []
        for a, z in zip([0, *ends], ends):
            own = at[a:z]
            out.append(closer(hits[own], numbers[own] / by[own], reach[own], fresh[a:z]))
            if len(out) == 200:
                yield pd.concat(out)
                out = []
        if out:
            yield pd.concat(out)

    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    ids = lambda wanted: F.collect_list(F.when(wanted, F.col("id")))
    dealt = links.repartition("hit").groupBy("hit", block).agg(ids(F.col("new")).alias("new"), ids(~F.col("new")).alias("old"))
    return dealt.join(placed, "hit").repartitionById(blocks, "block").select("hit", "vector", "reach", "new", "old").mapInPandas(run, EDGES)


#: Vectors that are held against all others at once by the exact graph: 32 MB at 4,096 dimensions.
BLOCK = 1000


def exact_graph(vectors: DataFrame, k: int = 15) -> DataFrame:
    """(id, hit, distance): just the k nearest of every vector. The table is held against itself in blocks of ``BLOCK``: for small tables alone."""
    spark = vectors.sparkSession
    blocks = max(1, -(-vectors.count() // BLOCK))
    best = None
    for block in range(blocks):
        some = vectors.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toPandas()  # about BLOCK vectors
        if not len(some):
            continue
        ids, matrix = spark.sparkContext.broadcast(some["id"].to_numpy()), spark.sparkContext.broadcast(matrix_of(some["vector"]))

        def run(batches: Iterator[pd.DataFrame], ids=ids, matrix=matrix) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for own, vector in zip(batch["id"], matrix_of(batch["vector"]) if len(batch) else ()):
                    d = distances(vector, matrix.value)
                    order = [m for m in np.lexsort((ids.value, d))[: k + 1] if ids.value[m] != own][:k]
                    out += [(own, int(ids.value[m]), float(d[m])) for m in order]
                yield pd.DataFrame(out, columns=["id", "hit", "distance"])

        one = vectors.mapInPandas(run, EDGES)
        best = one if best is None else nearest(best.unionByName(one), k)
    return spark.createDataFrame([], EDGES) if best is None else nearest(best, k)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact edges that were found."""
    both = exact.select("id", "hit").join(found.select("id", "hit").withColumn("here", F.lit(1)), ["id", "hit"], "left")
    return both.agg(F.coalesce(F.avg(F.coalesce("here", F.lit(0))), F.lit(1.0))).first()[0]
