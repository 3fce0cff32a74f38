"""Paged feeds as Python data sources: mail, calendar, chat, repositories. A feed is a folder of JSON pages, one file for each cursor value.

``register(spark)`` makes them available as ``spark.read.format("paged_feed")`` and ``spark.readStream.format("paged_feed")``: the stream's offset is the number of the
last page, so a restart continues where the checkpoint says.
"""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader
from pyspark.sql.types import ArrayType, StructType

SCHEMA = "page int, item string"


def _pages(folder: str) -> list[str]:
    return sorted(f for f in os.listdir(folder) if f.endswith(".json"))


def _items(folder: str, page: int, name: str):
    with open(os.path.join(folder, name)) as lines:
        content = json.load(lines)
    listed = next((content[k] for k in ("messages", "items", "channels", "commits") if k in content), None) if isinstance(content, dict) else content
    for item in [content] if listed is None else listed:
        yield page, json.dumps(item)


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        return [InputPartition((k, name)) for k, name in enumerate(_pages(self.folder))]

    def read(self, partition):
        yield from _items(self.folder, *partition.value)


class _Stream(SimpleDataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self):
        return {"page": 0}

    def read(self, start):
        names = _pages(self.folder)
        rows = [r for k in range(start["page"], len(names)) for r in _items(self.folder, k, names[k])]
        return iter(rows), {"page": len(names)}

    def readBetweenOffsets(self, start, end):
        names = _pages(self.folder)
        return iter([r for k in range(start["page"], end["page"]) for r in _items(self.folder, k, names[k])])


class PagedFeed(DataSource):
    """A folder of JSON pages; each item is a JSON text."""

    @classmethod
    def name(cls):
        return "paged_feed"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"])

    def simpleStreamReader(self, schema):
        return _Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedFeed)


def not_indexed(ids: DataFrame, chunks: DataFrame, most: int | None = None) -> DataFrame:
    """Ids without a first chunk in the store, the newest ``most`` of them."""
    new = ids.join(chunks.where("chunk_index = 0").select("source_id"), "source_id", "left_anti")
    return new if most is None else new.orderBy(F.desc("history_id"), "source_id").limit(most)


def high_water(messages: DataFrame, by: str, column: str) -> DataFrame:
    """The furthest value seen for each feed: the next cursor."""
    return messages.groupBy(by).agg(F.max(column).alias("cursor"))


def backfill_step(messages: DataFrame, low: Column, floor: Column, n: int) -> DataFrame:
    """The next ``n`` messages walking back from the low-water mark, not past the floor."""
    return messages.where((F.col("ts") < low) & (F.col("ts") >= floor)).orderBy(F.desc("ts")).limit(n)


def wanted_channels(channels: DataFrame, include: list[str], exclude: list[str], archived: bool = False, direct: bool = True) -> DataFrame:
    """An include list overrides excludes; archived and direct channels by choice."""
    kept = F.lit(True) if archived else ~F.coalesce("is_archived", F.lit(False))
    if not direct:
        kept = kept & ~(F.coalesce("is_im", F.lit(False)) | F.coalesce("is_mpim", F.lit(False)))
    named = F.col("name").isin(include) | F.col("id").isin(include) if include else ~F.coalesce(F.col("name").isin(exclude) | F.col("id").isin(exclude), F.lit(False))
    return channels.where(kept & named)


def calendar_events(items: DataFrame, account: str) -> DataFrame:
    """Flat calendar events: cancelled ones are deletions, times fall back to dates."""
    schema = "id string, status string, summary string, description string, location string, start struct<dateTime:string,date:string>, end struct<dateTime:string,date:string>, organizer struct<email:string,displayName:string>, creator struct<email:string>, attendees array<struct<email:string,displayName:string,responseStatus:string,self:boolean>>, htmlLink string, updated string, recurringEventId string"
    e = items.select(F.from_json("item", schema).alias("e")).select("e.*")
    return e.select(
        F.concat(F.lit(f"google-calendar://{account}/event/"), "id").alias("source_id"),
        F.when(F.col("status") == "cancelled", "deleted").otherwise("created").alias("operation"),
        "summary", "description", "location", F.coalesce("start.dateTime", "start.date").alias("start_time"), F.coalesce("end.dateTime", "end.date").alias("end_time"),
        F.lit(account).alias("account"), F.col("recurringEventId").alias("series_id"), "organizer", "creator", "attendees", F.col("htmlLink").alias("html_link"),
    )


_LEAVES = ArrayType(StructType().add("mime", "string").add("name", "string").add("data", "string").add("size", "long"))


def message_parts(payload: dict) -> list[tuple]:
    """(type, file name, data, size) of a message and all its parts, at any depth, in the order in which they are written."""
    out, stack = [], [payload]
    while stack:
        part = stack.pop()
        body = part.get("body") or {}
        out.append((part.get("mimeType"), part.get("filename"), body.get("data"), body.get("size")))
        stack += [p for p in reversed(part.get("parts") or []) if isinstance(p, dict)]
    return out


@F.pandas_udf(_LEAVES)
def _leaves(items: pd.Series) -> pd.Series:
    found = (json.loads(i).get("payload") if i else None for i in items)
    return pd.Series([message_parts(p) if isinstance(p, dict) else [] for p in found])


def mail_messages(items: DataFrame, account: str) -> DataFrame:
    """Flat mail: headers by name, plain body before HTML, at whatever depth of parts."""
    schema = "id string, threadId string, historyId string, internalDate string, payload struct<headers:array<struct<name:string,value:string>>>"
    m = items.select(F.from_json("item", schema).alias("m"), _leaves("item").alias("leaves")).select("m.*", "leaves")
    header = lambda name: F.get(F.filter("payload.headers", lambda h: F.lower(h["name"]) == name), F.lit(0))["value"]
    text = lambda kind: F.get(F.filter("leaves", lambda p: (p["mime"] == kind) & p["data"].isNotNull()), F.lit(0))["data"]
    decoded = lambda c: F.make_valid_utf8(F.unbase64(F.translate(c, "-_", "+/")).cast("string"))
    return m.select(
        F.concat(F.lit(f"gmail://{account}/message/"), "id").alias("source_id"),
        F.col("threadId").alias("thread_id"), F.col("historyId").cast("long").alias("history_id"),
        header("subject").alias("subject"), header("from").alias("sender"), header("to").alias("recipients"), header("date").alias("date"),
        decoded(text("text/plain")).alias("plain"), decoded(text("text/html")).alias("html"),
        F.array_distinct(F.transform(F.filter("leaves", lambda p: F.coalesce(p["name"], F.lit("")) != ""), lambda p: F.struct(p["name"].alias("name"), p["mime"].alias("mime"), p["size"].alias("size")))).alias("attachments"),
    )
