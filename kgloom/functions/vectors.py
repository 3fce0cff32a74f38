"""Vector arithmetic on array columns, in doubles, and searches over them."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths > 0, dot(a, b) / lengths).otherwise(0.0)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x))


def literal(vector) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def clamp_k(k: int) -> int:
    return max(1, min(int(k), 1000))


def top_k(vectors: DataFrame, query: Column, k: int = 10, where: Column | None = None, id_col: str = "source_id", vector_col: str = "vector") -> DataFrame:
    """The ``k`` rows of highest cosine, ties by id: a filter first, then one heap per partition."""
    rows = vectors if where is None else vectors.where(where)
    return rows.withColumn("score", cosine(F.col(vector_col), query)).orderBy(F.desc("score"), F.asc(id_col)).limit(clamp_k(k))


#: Seeds that are broadcast at once: with 4,096 dimensions of 8 bytes, 32 MB.
SEED_BLOCK = 1000


def neighbours(seeds: DataFrame, vectors: DataFrame, k: int, least: float, id_col: str = "source_id", vector_col: str = "vector") -> DataFrame:
    """(seed, hit, score) of each seed's ``k`` best hits at or over ``least``, itself excluded; vectors without a number score nothing.

    ``seeds`` is a stated set held against all vectors in blocks of about ``SEED_BLOCK``, so what is broadcast does not grow with the seeds.
    """
    s = seeds.select(F.col(id_col).alias("seed"), F.col(vector_col).alias("sv"), norm(F.col(vector_col)).alias("sn"))
    v = vectors.select(F.col(id_col).alias("hit"), F.col(vector_col).alias("hv"), norm(F.col(vector_col)).alias("hn"))
    lengths = F.col("sn") * F.col("hn")
    score = F.when(lengths > 0, dot(F.col("sv"), F.col("hv")) / lengths).otherwise(0.0)
    blocks = max(1, -(-s.count() // SEED_BLOCK))
    best = None
    for block in range(blocks):
        some = s.where(F.pmod(F.xxhash64("seed", "sv"), F.lit(blocks)) == block) if blocks > 1 else s
        scored = v.join(F.broadcast(some), F.col("seed") != F.col("hit")).withColumn("score", score).where((F.col("score") >= least) & ~F.isnan("score"))
        one = scored.groupBy("seed", "hit").agg(F.max("score").alias("score"))
        best = one if best is None else best.unionByName(one)
    best = best if blocks == 1 else best.groupBy("seed", "hit").agg(F.max("score").alias("score"))  # rows of one seed can fall into several blocks
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "hit"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


def centroids(vectors: DataFrame, cluster_col: str, vector_col: str = "vector") -> DataFrame:
    """Element-wise mean of each cluster's vectors: (cluster, pos, value, n). Noise (-1) is left out. A row for each position, so no array is gathered."""
    each = vectors.where(F.col(cluster_col) != -1).select(F.col(cluster_col).alias("cluster"), F.posexplode(vector_col).alias("pos", "x"))
    return each.groupBy("cluster", "pos").agg(F.avg(F.col("x").cast("double")).alias("value"), F.count("*").alias("n"))


def centroid_arrays(vectors: DataFrame, cluster_col: str, vector_col: str = "vector") -> DataFrame:
    """One row for each cluster; its array has as many values as a vector."""
    rows = centroids(vectors, cluster_col, vector_col)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda p: p["value"])
    return rows.groupBy("cluster").agg(ordered.alias("centroid"), F.max("n").alias("n"))


def central_members(vectors: DataFrame, cluster_col: str, id_col: str, n: int = 20, vector_col: str = "vector") -> DataFrame:
    """The ``n`` members of each cluster nearest to its centroid."""
    held = vectors.join(centroid_arrays(vectors, cluster_col, vector_col), F.col(cluster_col) == F.col("cluster"))
    rank = F.row_number().over(Window.partitionBy("cluster").orderBy("distance", id_col))
    return held.withColumn("distance", l2(F.col(vector_col), F.col("centroid"))).withColumn("rank", rank).where(F.col("rank") <= n).select("cluster", id_col, "distance", "rank")


Scorer = Callable[[str, list[str]], list[float]]


def overlap_scorer(question: str, texts: list[str]) -> list[float]:
    """Stand-in for a cross-encoder: share of the question's words that a text has."""
    words = set(question.lower().split())
    return [len(words & set(t.lower().split())) / max(1, len(words)) for t in texts]


def rerank(candidates: DataFrame, question: str, k: int, least: float = 0.0, scorer: Scorer = overlap_scorer, text_col: str = "text", pos_col: str = "pos") -> DataFrame:
    """Candidates rescored in batches, dropped under ``least``, best first, earlier position first on ties.

    A scorer that fails, or gives another number of scores, leaves its batch unscored: these rows have no score, are not dropped, and keep their order behind the scored ones.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch[text_col].fillna("").tolist()
            try:
                scores = [float(x) for x in scorer(question, texts)]
            except Exception:
                log.exception("the scorer failed; %d candidates keep their order", len(texts))
                scores = []
            yield batch.assign(rerank_score=pd.Series(scores if len(scores) == len(texts) else [None] * len(texts), index=batch.index, dtype="float64"))

    scored = candidates.mapInPandas(run, candidates.schema.simpleString()[7:-1] + ",rerank_score double")
    scored = scored.withColumn("rerank_score", F.when(~F.isnan("rerank_score"), F.col("rerank_score")))
    return scored.where((F.col("rerank_score") >= least) | F.col("rerank_score").isNull()).orderBy(F.desc_nulls_last("rerank_score"), pos_col).limit(max(0, k))


def hashing_embedder(dims: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Deterministic stand-in for an embedding model: signed hashing of words."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * dims
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                v[h % dims] += 1.0 if h & 0x80000000 else -1.0
            out.append(v)
        return out

    return embed


Embedder = Callable[[list[str]], list[list[float]]]
# Characters of a text that are embedded, and of one that the model finds too long.
LONGEST_EMBEDDED, LONGEST_AGAIN = 6000, 500


class ContextOverflow(ValueError):
    """An embedder raises this for a text that is longer than its context."""


def fitted(text: str, most: int = LONGEST_EMBEDDED) -> str:
    """What is embedded of a text: its beginning up to the last space, if that is in the second half."""
    if len(text) <= most:
        return text
    space = text.rfind(" ", 0, most)
    return text[: space if space > most // 2 else most]


def embed_texts(model: Embedder, texts: list[str]) -> list[list[float] | None]:
    """A vector for each text. Where a batch overflows its texts go one by one, and one that still does is cut short; null if even that is too long. Other errors are raised."""

    def exact(part: list[str]) -> list[list[float]]:
        vectors = model(part)
        if len(vectors) != len(part):
            raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
        return vectors

    def alone(text: str) -> list[float] | None:
        for part in (text, text[:LONGEST_AGAIN]):
            try:
                return exact([part])[0]
            except ContextOverflow:
                continue
        log.warning("a text of %d characters has no vector", len(text))
        return None

    short = [fitted(t) for t in texts]
    try:
        return list(exact(short)) if short else []
    except ContextOverflow:
        return [alone(t) for t in short]


def embed_column(rows: DataFrame, embedder: Embedder | None = None, text_col: str = "text", batch: int = 64) -> DataFrame:
    """``rows`` with a vector for each text, null where ``embed_texts`` gives none; the model is called for ``batch`` texts at a time."""
    model = embedder or hashing_embedder()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            texts = part[text_col].fillna("").tolist()
            yield part.assign(vector=[v for k in range(0, len(texts), batch) for v in embed_texts(model, texts[k : k + batch])])

    return rows.mapInPandas(run, rows.schema.simpleString()[7:-1] + ",vector array<float>")
