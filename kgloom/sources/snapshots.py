"""Snapshots of a source and what changed between two of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OPERATIONS = ("created", "modified", "deleted")


def diff(current: DataFrame, stored: DataFrame, key: str, changed: Column) -> DataFrame:
    """(key, operation) of rows that are new, changed or gone. ``changed`` compares ``c.`` with ``s.`` columns. One full outer join on the key."""
    joined = current.alias("c").join(stored.alias("s"), F.col(f"c.{key}") == F.col(f"s.{key}"), "full_outer")
    kind = F.when(F.col(f"s.{key}").isNull(), OPERATIONS[0]).when(F.col(f"c.{key}").isNull(), OPERATIONS[2]).when(changed, OPERATIONS[1])
    return joined.select(F.coalesce(f"c.{key}", f"s.{key}").alias(key), kind.alias("operation")).where("operation IS NOT NULL")


def file_changes(current: DataFrame, stored: DataFrame) -> DataFrame:
    """By path; a file is modified if its hash or time differs. Its size doesn't count; files that are not hashed have ''."""
    return diff(current, stored, "path", ~F.col("c.sha256").eqNullSafe(F.col("s.sha256")) | ~F.col("c.mtime_ns").eqNullSafe(F.col("s.mtime_ns")))


def version_changes(current: DataFrame, stored: DataFrame) -> DataFrame:
    return diff(current, stored, "name", ~F.col("c.version").eqNullSafe(F.col("s.version")))


def fields_hash(*columns: str, sets: tuple[str, ...] = ()) -> Column:
    """Hash of a row's mutable fields; the order within ``sets`` doesn't count."""
    return F.sha2(F.to_json(F.struct(*columns, *(F.array_sort(c).alias(c) for c in sets)), {"ignoreNullFields": "false"}), 256)


def task_changes(current: DataFrame, stored: DataFrame, fields: tuple[str, ...], sets: tuple[str, ...] = ("tags",)) -> DataFrame:
    hashed = lambda df: df.select("source_id", fields_hash(*fields, sets=sets).alias("hash"))
    return diff(hashed(current), hashed(stored), "source_id", F.col("c.hash") != F.col("s.hash"))


def scan_files(spark: SparkSession, root: str, glob: str = "*", max_bytes: int = 10 << 20, index_only: Column | None = None) -> DataFrame:
    """path, mtime_ns, size and sha256 of the files under ``root``; hash '' for large files and those only listed. Two scans: one lists and never asks for content,
    the other reads files up to ``max_bytes`` alone, as a filter on ``length`` reaches the source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    named = lambda rows, sha: rows.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"), sha.alias("sha256"))
    small, hidden = F.col("length") <= max_bytes, F.lit(False) if index_only is None else F.coalesce(index_only, F.lit(False))
    return named(files.where(~small | hidden), F.lit("")).unionByName(named(files.where(small).where(~hidden), F.sha2("content", 256)))


def new_files(spark: SparkSession, root: str, glob: str = "*", max_files: int = 1000) -> DataFrame:
    """A stream of created files (source_id, operation, mtime, size, content) under ``root``. It sees each path once: changes and deletions come from ``file_changes`` of two scans."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    stream = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).option("maxFilesPerTrigger", max_files).load(root)
    return stream.select(F.regexp_replace("path", "^file:(//)?", "").alias("source_id"), F.lit(OPERATIONS[0]).alias("operation"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def scan_vault(spark: SparkSession, root: str) -> DataFrame:
    """Notes of a vault, without its settings folder."""
    return scan_files(spark, root, "*.md").where(~F.col("path").rlike(r"/\.obsidian/"))


def recent_duplicates_dropped(events: DataFrame, seconds: int = 5) -> DataFrame:
    """Of a stream: a path and hash that were seen within the window are dropped."""
    return events.withWatermark("enqueued_at", f"{seconds} seconds").dropDuplicatesWithinWatermark(["path", "sha256"])


def series_text_once(events: DataFrame) -> DataFrame:
    """Of a recurring series only the first event keeps its text."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy("series_id").orderBy("start_time", "source_id")) == 1
    return events.withColumn("text", F.when(F.col("series_id").isNull() | first, F.col("text")).otherwise(""))


def package_snapshot(json_lines: DataFrame) -> DataFrame:
    """name, version and kind from a package manager's JSON."""
    schema = "formulae array<struct<name:string,desc:string,versions:struct<stable:string>,installed:array<struct<version:string>>>>, casks array<struct<token:string,desc:string,version:string,installed:string>>"
    got = json_lines.select(F.from_json("value", schema).alias("j"))
    formulae = got.select(F.explode("j.formulae").alias("p")).select("p.name", F.coalesce(F.get("p.installed", F.lit(0))["version"], F.col("p.versions.stable")).alias("version"), F.lit("formula").alias("kind"))
    casks = got.select(F.explode("j.casks").alias("p")).select(F.col("p.token").alias("name"), F.coalesce("p.installed", "p.version").alias("version"), F.lit("cask").alias("kind"))
    return formulae.unionByName(casks)
