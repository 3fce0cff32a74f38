"""Tables kept as hash buckets: a batch reads and rewrites the buckets that its keys fall into, so what it writes follows the batch and not the table.

A head (see ``ingest.Store``) names, for every table, the number of its buckets and for each bucket the folders of its rows. A batch writes new folders for touched buckets beside the old
ones and then the next head, so readers see all of a batch or nothing of it, and a batch that died is run again. At a hundred times the data give ``buckets`` a hundred times its number:
a bucket is what a batch pays for each of its keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chunking, text as T, vectors as V
from ..operators import writers
from ..sources import parsers
from ..tables import staged
from . import ingest

#: Files of a bucket that are written by tasks of their own, so that a hot key's rows are shared out.
SPREAD = 8
#: Parts of an appended bucket before they are made one.
MOST_PARTS = 8


class BucketStore(ingest.Store):
    """Tables of given schemas, each in buckets by one column. A bucket's number is a hash of its key; null keys have one too.

    The first write fixes the number of buckets. A table that was never written is empty, and so is a bucket without rows. One writer at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], keys: dict[str, str], buckets: int = 64):
        super().__init__(spark, folder)
        self.schemas, self.keys = schemas, keys
        self.buckets = self._names().get("buckets", buckets)

    def bucket_of(self, key: Column | str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame, key: str) -> set[int]:
        """The buckets of the rows' keys: no more numbers than the table has buckets."""
        return {r[0] for r in rows.select(self.bucket_of(key)).distinct().collect()}

    def _parts(self, name: str) -> dict[str, list[str]]:
        return self._names().get("tables", {}).get(name, {})

    def read(self, name: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """A table, or those buckets of it alone: only their files are listed and read."""
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [f"{self.folder}/{part}" for b, parts in self._parts(name).items() if wanted is None or b in wanted for part in parts]
        return self.spark.read.schema(self.schemas[name]).parquet(*paths) if paths else self.spark.createDataFrame([], self.schemas[name])

    def _put(self, name: str, rows: DataFrame) -> dict[str, str]:
        """Writes rows as a new version; the folder of each bucket that has any."""
        version, columns = f"{name}-{uuid.uuid4().hex}", self.spark.createDataFrame([], self.schemas[name]).columns
        placed = rows.select(*columns, self.bucket_of(self.keys[name]).alias("_bucket"))
        share = F.pmod(F.xxhash64(*columns), F.lit(SPREAD))
        placed.repartition(F.col("_bucket"), share).write.partitionBy("_bucket").parquet(f"{self.folder}/{version}")
        found = [f.getPath().getName() for f in self._fs.listStatus(self._path(f"{self.folder}/{version}"))]
        return {n.split("=")[1]: f"{version}/{n}" for n in found if n.startswith("_bucket=")}

    def commit(self, replaced: dict[str, tuple[DataFrame, Iterable[int]]], appended: dict[str, DataFrame] | None = None) -> None:
        """One change of several tables. ``replaced``: all rows of the buckets named, which take the place of theirs. ``appended``: rows that are laid beside a bucket's others.

        Rows of a replaced table must lie in the buckets named. An appended bucket of more than ``MOST_PARTS`` parts is read and written as one, without repeated rows.
        """
        heads, names = self._heads(), self._names()
        tables = {n: dict(names.get("tables", {}).get(n, {})) for n in self.schemas}
        for name, (rows, buckets) in replaced.items():
            buckets = {str(b) for b in buckets}
            if not buckets:
                continue
            new = self._put(name, rows)
            if stray := set(new) - buckets:
                raise ValueError(f"rows of {name} in buckets that were not to be written: {sorted(stray)}")
            tables[name] = {b: p for b, p in tables[name].items() if b not in buckets} | {b: [p] for b, p in new.items()}
        for name, rows in (appended or {}).items():
            for b, part in self._put(name, rows).items():
                tables[name][b] = [*tables[name].get(b, []), part]
            if full := [b for b, parts in tables[name].items() if len(parts) > MOST_PARTS]:
                paths = [f"{self.folder}/{part}" for b in full for part in tables[name][b]]
                new = self._put(name, self.spark.read.schema(self.schemas[name]).parquet(*paths).distinct())
                tables[name] |= {b: [new[b]] for b in full}
        names = {"buckets": self.buckets, "tables": tables}
        self._publish(heads, names)
        self._clean(heads, names)

    def write(self, **tables: DataFrame) -> None:
        """Whole tables in place of what they held."""
        self.commit({name: (rows, range(self.buckets)) for name, rows in tables.items()})

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """Rows replace those of equal ``keys``, which include the bucket's column; of a batch's rows of one key any one stays, so make them single before."""
        buckets = self.touched(rows, self.keys[name])
        self.commit({name: (writers.upsert(self.read(name, buckets), rows.dropDuplicates(keys), keys), buckets)})

    @staticmethod
    def _named(names: dict) -> set[str]:
        return {part for table in names.get("tables", {}).values() for parts in table.values() for part in parts}

    def _clean(self, heads: list[int], names: dict) -> None:
        """Removes what neither this head nor the one before names: buckets that an older head named, versions that no head names, and then the older heads."""
        parts = self._named(names) | (self._named(self._names(heads[-1])) if heads else set())
        versions = {p.split("/")[0] for p in parts}
        for old in heads[:-1]:
            for part in self._named(self._names(old)) - parts:
                if part.split("/")[0] in versions:
                    self._fs.delete(self._path(f"{self.folder}/{part}"), True)
        for found in self._fs.listStatus(self._path(self.folder)):
            name = found.getPath().getName()
            if name.startswith("new-") or (name.rsplit("-", 1)[0] in self.schemas and name not in versions):
                self._fs.delete(found.getPath(), True)
        for old in heads[:-1]:
            self._fs.delete(self._path(f"{self.folder}/head-{old}.json"), False)


def graph_store(spark: SparkSession, folder: str, buckets: int = 64) -> BucketStore:
    """The tables of ``ingest.TABLES`` by document, and for each target the sources of edges into it. The latter is only ever appended to, so it may name sources whose edge is gone:
    it tells which buckets to read, not which edges there are."""
    schemas = ingest.TABLES | {"edges_in": "dst_id string, src_id string"}
    return BucketStore(spark, folder, schemas, {"nodes": "source_id", "edges": "src_id", "chunks": "source_id", "vectors": "source_id", "edges_in": "dst_id"}, buckets)


def apply_batch(store: BucketStore, events: DataFrame, label: str = "File", embedder=None) -> None:
    """``ingest.apply_batch`` for a ``graph_store``: the same tables, of which only touched buckets are read and written.

    Documents whose content is as it was touch the nodes' buckets alone. A deleted document touches the buckets of its sources too: those with edges into it. A batch that is applied again
    changes nothing but its files; an empty one writes nothing.
    """
    with staged(store.spark) as put:
        named = events.where("source_id IS NOT NULL")
        here = store.touched(named, "source_id")
        if not here:
            return
        nodes = store.read("nodes", here)
        known = nodes.select("source_id", F.col("content_hash").alias("_old"))
        # the last event of a document and what is known of it meet in one shuffle; only texts that are read again are stored
        read = named.withColumn("text", F.when(F.coalesce(F.col("operation"), F.lit("")) != "deleted", F.col("text")))
        last = writers.latest(read, ["source_id"], F.desc("enqueued_at")).withColumn("content_hash", T.content_hash(F.col("text"))).join(known, "source_id", "left")
        new = F.coalesce((F.col("operation") != "deleted") & ~F.col("content_hash").eqNullSafe(F.col("_old")), F.lit(False))
        last = put(last.withColumn("new", new).withColumn("text", F.when(F.col("new"), F.col("text"))).drop("_old"), "batch")
        deleted, live, changed = last.where("operation = 'deleted'"), last.where("operation <> 'deleted'"), last.where("new").drop("new")
        gone = deleted.select("source_id").unionByName(changed.select("source_id"))
        content = store.touched(gone, "source_id")
        targets = deleted.select(F.col("source_id").alias("dst_id"))
        pointing = store.read("edges_in", store.touched(targets, "dst_id")).join(targets, "dst_id", "left_semi")
        linked = content | store.touched(pointing, "src_id")
        nodes, edges, chunks, vectors = writers.delete_documents(deleted, nodes, store.read("edges", linked), store.read("chunks", content), store.read("vectors", content))
        fresh = live.select(F.lit(label).alias("label"), "source_id", "source_type", "content_hash", F.col("enqueued_at").alias("indexed_at"))
        new_edges = put(parsers.mentions(changed, label), "edges")
        new_chunks = put(chunking.chunks(changed), "chunks")
        embedded = V.embed_column(new_chunks, embedder).where("vector IS NOT NULL")
        store.commit(
            {
                "nodes": (writers.upsert(nodes, fresh, ["source_id"]), here),
                "edges": (writers.merge_edges(writers.drop_rows(edges, gone.withColumnRenamed("source_id", "src_id"), ["src_id"]), new_edges), linked),
                "chunks": (writers.drop_rows(chunks, gone, ["source_id"]).unionByName(new_chunks), content),
                "vectors": (writers.drop_rows(vectors, gone, ["source_id"]).unionByName(embedded), content),
            },
            {"edges_in": new_edges.select("dst_id", "src_id").distinct()} if content else None,
        )
