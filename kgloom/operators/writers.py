"""Writers as table transforms: each takes the old table and the new rows and gives the next version."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Relations that triples may have, and what other words for them become.
PREDICATES = (
    "RELATED_TO",
    "WORKS_AT",
    "WORKS_FOR",
    "WORKS_ON",
    "KNOWS",
    "COLLABORATES_WITH",
    "USES",
    "USED_BY",
    "CREATED_BY",
    "CREATED",
    "PART_OF",
    "BELONGS_TO",
    "CONTAINS",
    "DEPENDS_ON",
    "IS_A",
    "HAS_A",
    "LOCATED_IN",
    "MANAGES",
    "REPORTS_TO",
    "CONTRIBUTED_TO",
    "BASED_ON",
    "DERIVED_FROM",
    "ASSOCIATED_WITH",
    "FOUNDED",
    "FUNDED_BY",
    "PUBLISHED",
    "AUTHORED",
    "EMPLOYED_BY",
    "AFFILIATED_WITH",
    "MEMBER_OF",
    "MENTIONS",
    "REFERENCES",
    "IMPLEMENTS",
    "EXTENDS",
    "INTEGRATES_WITH",
    "SUCCEEDED_BY",
    "PRECEDED_BY",
    "SAME_AS",
    "SIMILAR_TO",
    "OPPOSITE_OF",
    "INFLUENCED_BY",
    "SUPPORTS",
    "CONFLICTS_WITH",
    "ACQUIRED_BY",
    "INVESTED_IN",
    "DEVELOPED_BY",
    "MAINTAINED_BY",
    "OWNED_BY",
    "LED_BY",
    "TAUGHT_BY",
    "ATTENDED",
    "PARTICIPATED_IN",
    "SPOKE_AT",
    "INSTALLED_VIA",
    "CATEGORIZED_AS",
    "PROVIDES",
    "HAS_ROLE",
    "MEETS_WITH",
    "LOCATED_AT",
    "SENT_BY",
    "SENT_TO",
    "HOSTED_BY",
    "SCHEDULED_AT",
)
SYNONYMS = {
    "ATTENDS": "ATTENDED",
    "ATTENDEE": "ATTENDED",
    "ATTENDING": "ATTENDED",
    "PARTICIPATES_IN": "PARTICIPATED_IN",
    "INVOLVED_IN": "PARTICIPATED_IN",
    "HAS": "HAS_A",
    "OWNS": "OWNED_BY",
    "MEETS": "MEETS_WITH",
    "MET_WITH": "MEETS_WITH",
    "ROLE": "HAS_ROLE",
    "HOLDS_ROLE": "HAS_ROLE",
    "USED_FOR": "USES",
    "LOCATED_AT": "LOCATED_IN",
    "WORKS_IN": "WORKS_AT",
    "CONTACT": "ASSOCIATED_WITH",
    "CONTACT_FOR": "ASSOCIATED_WITH",
    "HAS_EMAIL": "ASSOCIATED_WITH",
    "EMAIL": "ASSOCIATED_WITH",
    "SENDS": "SENT_BY",
    "FROM": "SENT_BY",
    "DEVELOPS": "DEVELOPED_BY",
}


def predicate(raw: Column) -> Column:
    """Upper case with underscores, synonyms replaced, RELATED_TO where it isn't allowed."""
    name = F.replace(F.upper(F.trim(raw)), F.lit(" "), F.lit("_"))
    name = F.coalesce(T.lookup(SYNONYMS, name), name)
    return F.when(name.isin(*PREDICATES), name).otherwise("RELATED_TO")


def latest(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_nodes(nodes: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """Node rows (label, source_id, props): properties are set over the old ones, and the time of indexing."""
    old = nodes.select("label", "source_id", F.col("props").alias("_old"), F.col("indexed_at").alias("_at"))
    fresh = new.select("label", "source_id", F.col("props").alias("_new"))
    joined = old.join(fresh, ["label", "source_id"], "full_outer")
    none = F.create_map().cast("map<string,string>")
    was, now_set = F.coalesce("_old", none), F.coalesce("_new", none)
    merged = F.map_concat(F.map_filter(was, lambda k, _: ~F.array_contains(F.map_keys(now_set), k)), now_set)
    return joined.select("label", "source_id", merged.alias("props"), F.when(F.col("_new").isNotNull(), now).otherwise(F.col("_at")).alias("indexed_at"))


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Type and confidence change only for a strictly higher confidence; within a batch the first of equals counts. ``new`` has seq."""
    rows = old.select("name", "type", "confidence", F.lit(-1).cast("long").alias("seq")).unionByName(new.select(T.short_name(F.col("name")).alias("name"), "type", T.clamp_confidence(F.col("confidence")).alias("confidence"), F.col("seq").cast("long")))
    best = F.max_by(F.struct("type", "confidence"), F.struct("confidence", (-F.col("seq")).alias("s"))).alias("b")
    return rows.groupBy("name").agg(best).select("name", "b.*")


def merge_edges(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("src_label", "src_id", "rel", "dst_label", "dst_id")) -> DataFrame:
    """Edges are a set: one that is there stays as it is."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def triple_edges(triples: DataFrame) -> DataFrame:
    return triples.select(F.lit("Entity").alias("src_label"), T.short_name(F.col("subject")).alias("src_id"), predicate(F.col("predicate")).alias("rel"), F.lit("Entity").alias("dst_label"), T.short_name(F.col("object")).alias("dst_id")).distinct()


def person_names(rows: DataFrame) -> DataFrame:
    """The longest name of each person, the earlier of equals by seq."""
    return rows.groupBy("email").agg(F.max_by("name", F.struct(F.length("name"), (-F.col("seq")).alias("s"))).alias("name"))


def stale_chunks(chunks: DataFrame, counts: DataFrame) -> DataFrame:
    """Chunks at or over their document's present count (source_id, n)."""
    return chunks.join(counts, "source_id").where("chunk_index >= n").select(*chunks.columns)


def drop_rows(table: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return table.join(gone.select(*keys), keys, "left_anti")


def stale_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """A source's edges that its new version doesn't have."""
    return old.join(new.select("src_id").distinct(), "src_id", "left_semi").join(new.select("src_id", "rel", "dst_id"), ["src_id", "rel", "dst_id"], "left_anti")


def orphans(entities: DataFrame, edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate entities that no edge comes into."""
    return entities.join(candidates.select("name"), "name", "left_semi").join(edges.select(F.col("dst_id").alias("name")), "name", "left_anti")


def replace_hints(edges: DataFrame, new: DataFrame) -> DataFrame:
    """A modified source's hint edges make way for its new ones."""
    sources = new.select("src_id").distinct().withColumn("_new", F.lit(True))
    kept = edges.join(sources, "src_id", "left").where(~(F.coalesce("hint", F.lit(False)) & F.coalesce("_new", F.lit(False)))).drop("_new")
    return merge_edges(kept.select(*edges.columns), new)


def delete_documents(ids: DataFrame, nodes: DataFrame, edges: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The four tables without the documents (source_id)."""
    gone = ids.select("source_id").distinct()
    src, dst = gone.withColumnRenamed("source_id", "src_id"), gone.withColumnRenamed("source_id", "dst_id")
    return drop_rows(nodes, gone, ["source_id"]), drop_rows(drop_rows(edges, src, ["src_id"]), dst, ["dst_id"]), drop_rows(chunks, gone, ["source_id"]), drop_rows(vectors, gone, ["source_id"])


def replace_cluster_topics(topics: DataFrame, tagged: DataFrame, new_topics: DataFrame, new_tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics and tags made by clustering are replaced whole; only files, mails, commits and images are tagged."""
    ours = F.coalesce(F.col("source"), F.lit("")) == "cluster"
    fits = new_tagged.where(F.col("src_label").isin("File", "Email", "Commit", "Image")).dropDuplicates(["src_id", "dst_id"])
    return topics.where(~ours).unionByName(new_topics.dropDuplicates(["name", "source"]), allowMissingColumns=True), tagged.where(~ours).unionByName(fits, allowMissingColumns=True)


def audit(rows: DataFrame, path: str) -> None:
    rows.withColumn("at", F.current_timestamp()).write.mode("append").json(path)


def keep_newest(rows: DataFrame, order: Column, n: int = 100) -> DataFrame:
    """The newest ``n`` conversations or archives."""
    return rows.orderBy(order).limit(n)


def rewrite_ids(table: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Legacy ids under a prefix get the new one; what has it already stays."""
    c = F.col(column)
    return table.withColumn(column, F.when(c.startswith(old) & ~c.startswith(new), F.concat(F.lit(new), F.substring(c, len(old) + 1, 1 << 20))).otherwise(c))


def collisions(events: DataFrame, event: str = "event_id", calendar: str = "calendar_id") -> DataFrame:
    """Legacy event ids that more than one calendar has."""
    return events.groupBy(event).agg(F.count_distinct(calendar).alias("n")).where("n > 1")
