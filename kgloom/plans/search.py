"""Topics, vector and hybrid search, suggested connections, status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import filters
from ..operators.graph import without_existing

MOST_TOPICS, MOST_DOCUMENTS, MOST_GAPS = 500, 200, 500
SEEDS, NEIGHBOURS, THRESHOLD, LIMIT = 20, 10, 0.82, 20
# Results of a search, hits taken before a reranker, what is said of nothing.
MOST_RESULTS, BEFORE_RERANK, NOTHING = 100, 50, "No results found."


def list_topics(topics: DataFrame, tagged: DataFrame, source: str | None = None) -> DataFrame:
    """Topics with their number of documents, none included. Tags are counted before the join."""
    counts = tagged.groupBy("topic", "topic_source").agg(F.count("*").alias("doc_count"))
    found = topics.where(filters.optional_equal("source", source)).join(counts, (F.col("name") == F.col("topic")) & (F.col("source") == F.col("topic_source")), "left")
    return found.select("name", "source", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("doc_count", F.lit(0)).alias("doc_count")).orderBy("source", "name").limit(MOST_TOPICS)


def show_topic(name: str, tagged: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents of a topic: source_id, name, type."""
    ids = tagged.where(F.col("topic") == name).select("source_id").distinct()
    return documents.join(ids, "source_id").select("source_id", F.coalesce("name", "source_id").alias("name"), F.col("label").alias("type")).orderBy("name", "source_id").limit(MOST_DOCUMENTS)


def topic_gaps(topics: DataFrame, tagged: DataFrame) -> DataFrame:
    """Clustered topics that no user topic has the name of."""
    mine = topics.where("source = 'user'").select("name")
    counts = tagged.groupBy(F.col("topic").alias("name")).agg(F.count("*").alias("doc_count"))
    gaps = topics.where("source = 'cluster'").join(mine, "name", "left_anti").join(counts, "name", "left")
    return gaps.select("name", F.coalesce("description", F.lit("")).alias("description"), F.coalesce("doc_count", F.lit(0)).alias("doc_count")).orderBy(F.desc("doc_count"), "name").limit(MOST_GAPS)


def vector_search(vectors: DataFrame, query: Column, k: int = 10, source_type: str | None = None) -> DataFrame:
    where = filters.of_source("source_type", source_type) if source_type else None
    return V.top_k(vectors, query, k, where)


def hybrid_merge(graph_ids: DataFrame, hits: DataFrame, window=None, folders: list[str] | None = None) -> DataFrame:
    """Graph rows first, then vector hits that they don't cover, within a date window and journal folders: (lane, pos, source_id). ``hits`` and ``graph_ids`` have pos."""
    kept = hits.join(graph_ids.select("source_id"), "source_id", "left_anti")
    if window is not None:
        kept = kept.where(filters.in_dates(F.col("date"), *window))
    if folders:
        kept = kept.where(filters.in_folders(F.col("source_id"), folders))
    lane = lambda df, k: df.select(F.lit(k).alias("lane"), F.col("pos").cast("int").alias("pos"), "source_id")
    return lane(graph_ids, 0).unionByName(lane(kept, 1))


def context_text(graph_rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Both lanes as one prompt section each. The rows are a search's few results."""
    part = lambda df, head, line: df.agg(F.concat_ws("\n", F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), lambda x: x["line"]), "\n")).alias("text"), F.count("*").alias("n"))
    graph = part(graph_rows, "[Graph context]", F.concat(F.lit("- "), F.col("line")))
    vector = part(hits, "[Semantic context]", F.concat(F.lit("- ["), "source_type", F.lit("] "), "source_id", F.when(F.coalesce("date", F.lit("")) != "", F.concat(F.lit(" ("), "date", F.lit(")"))).otherwise(""), F.lit("\n  "), "text"))
    return graph.where("n > 0").unionByName(vector.where("n > 0")).select("text")


def first_rows(hits: DataFrame, k: int | None = None, pos_col: str = "pos") -> DataFrame:
    """What a reranker that changes nothing gives: the first ``k`` hits in their order."""
    ordered = hits.orderBy(pos_col)
    return ordered if k is None else ordered.limit(max(0, k))


def ordered_ids(rows: DataFrame) -> DataFrame:
    """Each source_id once, in the order of its first row: (pos, source_id). The rows are one search's results."""
    first = rows.where("source_id IS NOT NULL AND source_id <> ''").groupBy("source_id").agg(F.min(F.struct("lane", "pos")).alias("at"))
    return first.select(F.row_number().over(Window.orderBy("at", "source_id")).alias("pos"), "source_id")


def search(
    question: str,
    graph_rows: DataFrame,
    vectors: DataFrame,
    embed: Callable[[list[str]], list[list[float]]],
    k: int = 10,
    source_type: str | None = None,
    scorer: V.Scorer | None = None,
    window=None,
    folders: list[str] | None = None,
) -> DataFrame:
    """Graph rows (pos, source_id, line), then the vector hits that they don't cover: (lane, pos, source_id, source_type, line, score).

    ``vectors``: source_id, source_type, text, date, vector. With a ``scorer`` more hits are taken and reranked to ``k``. An empty question is an error.
    """
    if not question.strip():
        raise ValueError("the question is empty")
    k = max(1, min(int(k), MOST_RESULTS))
    hits = vector_search(vectors, V.literal(embed([question])[0]), BEFORE_RERANK if scorer else k, source_type)
    by_score = lambda df, score: df.withColumn("pos", F.row_number().over(Window.orderBy(F.desc(score), *(["pos"] if "pos" in df.columns else ["source_id"]))))  # noqa: E731  at most a thousand rows
    hits = by_score(hits, "score")
    if scorer:
        uncovered = hits.join(graph_rows.select("source_id"), "source_id", "left_anti").select("source_id", "source_type", "text", "date", "score", "pos")
        hits = by_score(V.rerank(uncovered, question, k, scorer=scorer).withColumn("score", F.col("rerank_score")), "score")
    merged = hybrid_merge(graph_rows, hits, window, folders)
    said = hits.select(F.lit(1).alias("lane"), F.col("pos").cast("int").alias("pos"), "source_type", F.col("text").alias("line"), "date", "score")
    known = graph_rows.select(F.lit(0).alias("lane"), F.col("pos").cast("int").alias("pos"), "line")
    told = known.unionByName(said, allowMissingColumns=True)
    return merged.join(told, ["lane", "pos"]).select("lane", "pos", "source_id", "source_type", "line", "date", "score").orderBy("lane", "pos")


def search_page(found: DataFrame) -> DataFrame:
    """What a search says as one text: graph context, semantic context, sources."""
    graph = found.where("lane = 0").select("pos", "line")
    hits = found.where("lane = 1").select("pos", "source_type", "source_id", "date", F.col("line").alias("text"))
    sources = ordered_ids(found).agg(F.array_sort(F.collect_list(F.struct("pos", "source_id"))).alias("s")).where(F.size("s") > 0)
    listed = sources.select(F.concat(F.lit("[Sources]\n"), F.array_join(F.transform("s", lambda x: x["source_id"]), "\n")).alias("text"))
    parts = context_text(graph, hits).unionByName(listed)
    order = F.when(F.col("text").startswith("[Graph"), 0).when(F.col("text").startswith("[Semantic"), 1).otherwise(2)
    page = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    return page.select(F.when(F.col("text") == "", NOTHING).otherwise(F.col("text")).alias("text"))


def confidence(n: int) -> str:
    return "none" if n == 0 else "sparse" if n < 3 else "good"


def first_values(rows: DataFrame, key: str, value: str, k: int) -> DataFrame:
    """(key, values): the k least different values of each key, null keys too. Ranks are cut in each task before the shuffle, so no more than k values of a key leave a task or are gathered."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(value))
    least = rows.where(F.col(value).isNotNull()).select(key, value).distinct().withColumn("_rank", rank).where(F.col("_rank") <= k)
    return least.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("values"))


def source_groups(rows: DataFrame) -> DataFrame:
    """Results by source type with up to three ids."""
    first = first_values(rows, "source_type", "source_id", 3).withColumnRenamed("source_type", "_type")
    counts = rows.groupBy("source_type").agg(F.count("*").alias("n"))
    return counts.join(first, F.col("source_type").eqNullSafe(F.col("_type")), "left").select("source_type", "n", F.array_join(F.coalesce("values", F.array().cast("array<string>")), ",").alias("ids"))


def suggest_connections(vectors: DataFrame, edges: DataFrame, info: DataFrame, seeds: DataFrame | None = None, threshold: float = THRESHOLD, limit: int = LIMIT, cross_source: bool = False) -> DataFrame:
    """Documents that are alike but not linked. Seeds are the first documents by id (or those given), held against all vectors; each pair counts once, at its best score.

    ``vectors``: source_id, chunk_index, vector. ``info``: source_id, label, title, source_type; a document without it is a ``Document`` named by its id.
    """
    if seeds is None:
        seeds = vectors.where("chunk_index = 0").orderBy("source_id").limit(SEEDS)
    hits = V.neighbours(seeds, vectors, NEIGHBOURS, threshold)
    pairs = hits.groupBy(F.least("seed", "hit").alias("a"), F.greatest("seed", "hit").alias("b")).agg(F.max("score").alias("score"))
    free = without_existing(pairs, edges)
    side = lambda s: info.select(F.col("source_id").alias(s), F.col("label").alias(f"label_{s}"), F.col("title").alias(f"title_{s}"), F.col("source_type").alias(f"type_{s}"))
    told = free.join(side("a"), "a", "left").join(side("b"), "b", "left")
    if cross_source:
        told = told.where(~F.col("type_a").eqNullSafe(F.col("type_b")))
    named = [c for s in "ab" for c in (F.coalesce(f"label_{s}", F.lit("Document")).alias(f"label_{s}"), F.coalesce(f"title_{s}", s).alias(f"title_{s}"), F.coalesce(f"type_{s}", F.lit("")).alias(f"type_{s}"))]
    return told.select("a", "b", *named, F.round("score", 4).alias("similarity")).orderBy(F.desc("similarity"), "a", "b").limit(max(1, min(limit, 200)))


def ingest_status(nodes: DataFrame, at: str = "modified_at") -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n"), F.max(at).alias("last"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("rel").agg(F.count("*").alias("n"))


def is_corpus_empty(nodes: DataFrame, vectors: DataFrame) -> bool:
    return nodes.isEmpty() and vectors.isEmpty()
