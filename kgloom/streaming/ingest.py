"""Ingest by micro-batches: change events are parsed, chunked, embedded and upserted; unchanged content is skipped.

Tables are kept as versions in a folder; a batch writes new versions whole and then names them in one small file, so a repeated batch gives the same tables (at-least-once delivery,
idempotent keys).
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, text as T, vectors as V
from ..operators import writers
from ..sources import parsers

TABLES = {
    "nodes": "label string, source_id string, source_type string, content_hash string, indexed_at timestamp",
    "edges": "src_label string, src_id string, rel string, dst_label string, dst_id string, confidence double, hint boolean",
    "chunks": "chunk_id string, source_id string, chunk_index int, text string",
    "vectors": "chunk_id string, source_id string, chunk_index int, text string, vector array<float>",
}


class Store:
    """The versions of the tables in a shared folder.

    A write puts new versions beside the old ones and then a head, the next number's, that names all tables. A head is created whole under another name and renamed, and none is ever
    replaced: after a crash at any step the last head that was renamed still names whole tables. Then heads and versions that neither this head nor the one before names are removed, so
    readers of the head before stay safe. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _heads(self) -> list[int]:
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.folder))]
        return sorted(int(n[5:-5]) for n in names if n.startswith("head-") and n.endswith(".json") and n[5:-5].isdecimal())

    def _names(self, head: int | None = None) -> dict[str, str]:
        heads = self._heads() if head is None else [head]
        return json.loads(self.spark.read.text(f"{self.folder}/head-{heads[-1]}.json", wholetext=True).first()[0]) if heads else {}

    def read(self, name: str) -> DataFrame:
        version = self._names().get(name)
        return self.spark.createDataFrame([], TABLES[name]) if version is None else self.spark.read.schema(TABLES[name]).parquet(f"{self.folder}/{version}")

    def write(self, **tables: DataFrame) -> None:
        heads, names = self._heads(), self._names()
        for name, df in tables.items():
            version = f"{name}-{uuid.uuid4().hex}"
            df.write.parquet(f"{self.folder}/{version}")
            names[name] = version
        self._publish(heads, names)
        self._clean(heads, names)

    def _publish(self, heads: list[int], names: dict) -> None:
        made = self._path(f"{self.folder}/new-{uuid.uuid4().hex}")
        out = self._fs.create(made, False)
        out.write(json.dumps(names).encode())
        out.close()
        if not self._fs.rename(made, self._path(f"{self.folder}/head-{(heads or [0])[-1] + 1}.json")):
            raise OSError("the tables' next head is there already: two writers")

    def _clean(self, heads: list[int], names: dict[str, str]) -> None:
        named = set(names.values()) | (set(self._names(heads[-1]).values()) if heads else set())
        stay = named | {f"head-{n}.json" for n in (heads[-1:] + [(heads or [0])[-1] + 1])}
        for found in self._fs.listStatus(self._path(self.folder)):
            name = found.getPath().getName()
            if name not in stay and (name.startswith(("head-", "new-")) or name.split("-")[0] in TABLES):
                self._fs.delete(found.getPath(), True)


def apply_batch(store: Store, events: DataFrame, label: str = "File", embedder=None) -> None:
    """One batch of events (source_id, source_type, operation, text, enqueued_at): the last of each document counts.

    Deleted documents go from all tables. Documents already indexed with equal content only get a new time. The others' chunks, vectors and hint edges are replaced.
    Events without a source_id name no document and are passed over.
    """
    nodes, edges, chunks, vectors = (store.read(n) for n in TABLES)
    last = writers.latest(events.where("source_id IS NOT NULL"), ["source_id"], F.desc("enqueued_at")).withColumn("content_hash", T.content_hash(F.col("text")))
    deleted, live = last.where("operation = 'deleted'"), last.where("operation <> 'deleted'")
    known = nodes.select("source_id", F.col("content_hash").alias("_old"))
    changed = live.join(known, "source_id", "left").where(~F.col("content_hash").eqNullSafe(F.col("_old"))).drop("_old")
    nodes, edges, chunks, vectors = writers.delete_documents(deleted, nodes, edges, chunks, vectors)
    fresh = live.select(F.lit(label).alias("label"), "source_id", "source_type", "content_hash", F.col("enqueued_at").alias("indexed_at"))
    new_chunks = chunking.chunks(changed)
    new_edges = parsers.mentions(changed, label)
    gone = changed.select("source_id")
    embedded = V.embed_column(new_chunks, embedder).where("vector IS NOT NULL")
    stale = gone.withColumnRenamed("source_id", "src_id")
    store.write(
        nodes=writers.upsert(nodes, fresh, ["source_id"]).select(*[c.split()[0] for c in TABLES["nodes"].split(", ")]),
        edges=writers.merge_edges(writers.drop_rows(edges, stale, ["src_id"]), new_edges),
        chunks=writers.drop_rows(chunks, gone, ["source_id"]).unionByName(new_chunks),
        vectors=writers.drop_rows(vectors, gone, ["source_id"]).unionByName(embedded),
    )


def start(stream: DataFrame, store: Store, checkpoint: str, label: str = "File"):
    """The ingest loop: every micro-batch through ``apply_batch``, offsets in the checkpoint."""
    return stream.writeStream.foreachBatch(lambda batch, _: apply_batch(store, batch, label)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
