"""Topics from vectors: reduction and density by built-in learners, labels, links of applications."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T, vectors as V

MIN_CLUSTER, MIN_CORPUS, MAX_VECTORS, REDUCED = 10, 20, 500_000, 32


def cluster_embeddings(vectors: DataFrame, k: int | None = None, dims: int = REDUCED, least: int = MIN_CLUSTER, corpus: int = MIN_CORPUS, most: int = MAX_VECTORS, seed: int = 42) -> DataFrame:
    """(id, cluster): principal components, then bisecting k-means; clusters under ``least`` members become noise (-1).

    Stands in for a manifold projection with density clustering, which no installed library offers: labels differ, the contract (noise left out, centroids in the original space, a gate on corpus
    size) is the same. The learner sees at most ``most`` vectors by id hash, a documented bound; every vector gets a cluster.
    """
    from pyspark.ml.clustering import BisectingKMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    n = vectors.count()
    if n < corpus:
        return vectors.limit(0).select("id", F.lit(-1).alias("cluster"))
    rows = vectors.select("id", array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    learn = rows if n <= most else rows.orderBy(F.xxhash64("id"), "id").limit(most)
    width = len(vectors.first()["vector"])
    if dims < width:
        reducer = PCA(k=dims, inputCol="features", outputCol="reduced").fit(learn)
        rows, learn, column = reducer.transform(rows), reducer.transform(learn), "reduced"
    else:
        column = "features"
    model = BisectingKMeans(k=k or max(2, min(50, n // (3 * least))), featuresCol=column, predictionCol="cluster", seed=seed, minDivisibleClusterSize=float(2 * least)).fit(learn)
    found = model.transform(rows).select("id", "cluster")
    sizes = found.groupBy("cluster").agg(F.count("*").alias("n"))
    return found.join(sizes, "cluster").select("id", F.when(F.col("n") >= least, F.col("cluster")).otherwise(-1).alias("cluster"))


def numbered_labels(labels: DataFrame, id_col: str = "cluster", label_col: str = "label") -> DataFrame:
    """Labels that occur again get `` (#n)``."""
    w = Window.partitionBy(label_col)
    n = F.row_number().over(w.orderBy(id_col))
    return labels.withColumn(label_col, F.when(n > 1, F.concat(label_col, F.lit(" (#"), n, F.lit(")"))).otherwise(F.col(label_col)))


def link_apps(apps: DataFrame, centroids: DataFrame, k: int = 3, least: float = 0.6) -> DataFrame:
    """Up to three topics of each application with a cosine of 0.6 and more. Centroids are few: one row for each cluster, at most some hundreds."""
    scored = apps.join(F.broadcast(centroids)).withColumn("score", V.cosine(F.col("vector"), F.col("centroid")))
    rank = F.row_number().over(Window.partitionBy("app").orderBy(F.desc("score"), "cluster"))
    return scored.where(F.col("score") >= least).withColumn("rank", rank).where(F.col("rank") <= k).select("app", "cluster", "score", "rank")


def chunk_sources(members: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents of each cluster, through its chunks."""
    return members.join(chunks.select(F.col("chunk_id").alias("id"), "source_id"), "id").groupBy("cluster").agg(F.array_sort(F.collect_set("source_id")).alias("sources"))


def cached_descriptions(apps: DataFrame, cache: DataFrame) -> DataFrame:
    """``apps`` (app, name, version) with the stored description, null where it must be made anew: none stored, another major version, or an unknown application renamed."""
    old = cache.select("app", F.col("name").alias("_name"), F.col("version").alias("_version"), F.col("description").alias("_description"))
    stale = ~T.major_version(F.col("version")).eqNullSafe(T.major_version(F.col("_version"))) | ((F.col("_description") == "Unknown application") & ~F.col("name").eqNullSafe(F.col("_name")))
    return apps.join(old, "app", "left").select("app", "name", "version", F.when(~F.coalesce(stale, F.lit(False)), F.col("_description")).alias("description"))
