"""Timeline and digest over files, tasks, mails, commits and applications.

Inputs are tables by label with timestamp columns: files (source_id, title, name, created, updated, indexed_at), tasks (source_id, name, status, creation_date, modification_date,
completion_date), mails (source_id, subject, date), commits (source_id, message, date), apps (source_id, name, indexed_at). Any may be left out; with a source filter only its branch is built.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.filters import within

MOST, USUAL, SNIPPET, HIGHLIGHTS = 500, 50, 200, 5
COLUMNS = ("source_id", "label", "title", "ts", "event_type")
BRANCH_OF = {"file": "files", "files": "files", "obsidian": "files", "omnifocus": "tasks", "gmail": "mails", "repositories": "commits", "apps": "apps"}


def _first_line(text: str) -> Column:
    return F.substring_index(text, "\n", 1)


def _file_event() -> Column:
    return F.when(F.col("created") == F.col("updated"), "created").otherwise("modified")


def _files(t: DataFrame, since: Column, until: Column) -> DataFrame:
    ts = F.coalesce("updated", "indexed_at", "created")
    return t.where(within(since, until, "updated", "created", "indexed_at")).select("source_id", F.lit("File").alias("label"), F.coalesce("title", "name", "source_id").alias("title"), ts.alias("ts"), _file_event().alias("event_type")).where(F.col("ts").between(since, until))


def _tasks(t: DataFrame, since: Column, until: Column) -> DataFrame:
    inside = lambda c: F.when(F.col(c).between(since, until), F.col(c))
    ts = F.coalesce(inside("completion_date"), inside("modification_date"), "creation_date")
    kind = F.when(F.col("status") == "completed", "completed").when(F.col("creation_date") == F.col("modification_date"), "created").otherwise("modified")
    return t.where(within(since, until, "modification_date", "completion_date", "creation_date")).select("source_id", F.lit("Task").alias("label"), F.coalesce("name", "source_id").alias("title"), ts.alias("ts"), kind.alias("event_type")).where(F.col("ts").between(since, until))


def _dated(label: str, title: Column, at: str, kind: str):
    def branch(t: DataFrame, since: Column, until: Column) -> DataFrame:
        return t.where(F.col(at).between(since, until)).select("source_id", F.lit(label).alias("label"), F.coalesce(title, F.col("source_id")).alias("title"), F.col(at).alias("ts"), F.lit(kind).alias("event_type"))

    return branch


def _branches():
    return {
        "files": _files,
        "tasks": _tasks,
        "mails": _dated("Email", F.col("subject"), "date", "created"),
        "commits": _dated("Commit", _first_line("message"), "date", "created"),
        "apps": _dated("Application", F.col("name"), "indexed_at", "modified"),
    }


def timeline(tables: dict[str, DataFrame], since: Column, until: Column, source_type: str | None = None, limit: int = USUAL, chunks: DataFrame | None = None) -> DataFrame:
    """The newest events of a window, ties by label and id; with ``chunks`` the first 200 characters of each document's first chunk."""
    wanted = {BRANCH_OF[source_type]} if source_type else set(tables)
    parts = [branch(tables[name], since, until) for name, branch in _branches().items() if name in wanted and name in tables]
    rows = reduce(DataFrame.unionByName, parts).orderBy(F.desc("ts"), "label", "source_id").limit(max(1, min(int(limit), MOST)))
    if chunks is None:
        return rows
    first = chunks.where("chunk_index = 0").select("source_id", F.substring("text", 1, SNIPPET).alias("snippet"))
    return rows.join(first, "source_id", "left").withColumn("snippet", F.coalesce("snippet", F.lit("")))


def _digest_branch(t: DataFrame, source: str, keep: Column, kind: Column, title: Column) -> DataFrame:
    counts = [F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("created", "modified", "completed")]
    picked = F.slice(F.array_sort(F.collect_set("title")), 1, HIGHLIGHTS)
    # distinct titles are found before they are gathered, and only the first few are kept
    rows = t.where(keep).select(kind.alias("kind"), F.coalesce(title, F.col("source_id")).alias("title"))
    titles = rows.select("title").distinct().orderBy("title").limit(HIGHLIGHTS).agg(picked.alias("highlights"))
    return rows.agg(*counts).join(F.broadcast(titles)).withColumn("source_type", F.lit(source))  # one row each


def digest(tables: dict[str, DataFrame], since: Column, until: Column) -> DataFrame:
    """created, modified (completed tasks among them), completed and the first five titles of each source with anything to tell."""
    task_kind = F.when((F.col("status") == "completed") & F.coalesce(F.col("completion_date").between(since, until), F.lit(False)), "completed").when(F.col("creation_date") == F.col("modification_date"), "created").otherwise("modified")
    plans = {
        "files": ("obsidian", within(since, until, "updated", "created", "indexed_at"), _file_event(), F.coalesce("title", "name")),
        "tasks": ("omnifocus", within(since, until, "modification_date", "completion_date", "creation_date"), task_kind, F.col("name")),
        "mails": ("gmail", F.col("date").between(since, until), F.lit("created"), F.col("subject")),
        "commits": ("repositories", F.col("date").between(since, until), F.lit("created"), _first_line("message")),
        "apps": ("apps", F.col("indexed_at").between(since, until), F.lit("modified"), F.col("name")),
    }
    parts = [_digest_branch(tables[name], *plan) for name, plan in plans.items() if name in tables]
    rows = reduce(DataFrame.unionByName, parts).where("created_count + modified_count + completed_count > 0")
    return rows.select("source_type", F.col("created_count").alias("created"), (F.col("modified_count") + F.col("completed_count")).alias("modified"), F.col("completed_count").alias("completed"), F.array_join("highlights", " | ").alias("highlights"))


def new_connections(edges: DataFrame, since: Column, until: Column, labels: tuple[str, ...] = ("File", "Task", "Email", "Commit", "Application")) -> DataFrame:
    """Edges made in the window between documents of different labels."""
    kept = F.col("created_at").between(since, until) & F.col("src_label").isin(*labels) & F.col("dst_label").isin(*labels) & (F.col("src_label") != F.col("dst_label"))
    return edges.where(kept).agg(F.count("*").alias("new_connections"))


def new_topics(topics: DataFrame, since: Column, until: Column) -> DataFrame:
    return topics.where(F.col("created_at").between(since, until)).agg(F.count("*").alias("new_topics"))


def by_day(rows: DataFrame) -> DataFrame:
    """Timeline rows by day, newest day first."""
    return rows.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).groupBy("day").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
