"""Person profile, pre-meeting brief and day itinerary on node and edge tables.

Nodes are (label, source_id, props map); edges as in the schema. A person is a cluster (source_id) of identity edges, found once and shared by all sections.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times, vectors as V
from ..operators.filters import is_open
from ..operators.graph import PERSON_RELATIONS, both_ways
from ..tables import written

p = lambda name: F.col("props")[name]


def _of(nodes: DataFrame, *labels: str) -> DataFrame:
    return nodes.where(F.col("label").isin(*labels))


def person_documents(cluster: DataFrame, edges: DataFrame) -> DataFrame:
    """(doc_id, rel) of everything but people tied to the cluster by a person relation, in either direction."""
    ends = both_ways(edges.where(F.col("rel").isin(*PERSON_RELATIONS)))
    return ends.where("other_label <> 'Person'").join(cluster.select(F.col("source_id").alias("id")), "id", "left_semi").select(F.col("other_id").alias("doc_id"), "rel")


def _documents(cluster: DataFrame, edges: DataFrame) -> DataFrame:
    """The ids of a person's documents, as a table, found from the cluster as one: their sizes are then known, so edges meet small ones where they are read, before they are made distinct."""
    return written(person_documents(written(cluster.select("source_id"), "cluster"), edges).select("doc_id").distinct(), "documents")


def interactions(cluster: DataFrame, nodes: DataFrame, edges: DataFrame, since: datetime, limit: int = 10) -> DataFrame:
    """Mails, meetings, chats and files of a person since a time, newest first."""
    docs = person_documents(cluster, edges).distinct().join(nodes.withColumnRenamed("source_id", "doc_id"), "doc_id")
    shape = {
        "Email": ("gmail", F.coalesce(p("date"), F.lit("")), F.coalesce(p("subject"), "doc_id"), ("SENT", "TO", "MENTIONS")),
        "CalendarEvent": ("google_calendar", F.coalesce(p("start_time"), F.lit("")), F.coalesce(p("summary"), "doc_id"), ("ATTENDED_BY", "ORGANIZED_BY", "CREATED_BY")),
        "CalendarSeries": ("google_calendar", F.coalesce(p("start_time"), F.lit("")), F.coalesce(p("summary"), "doc_id"), ("ATTENDED_BY", "ORGANIZED_BY", "CREATED_BY")),
        "SlackMessage": ("slack", F.coalesce(p("last_ts"), p("first_ts"), F.lit("")), F.coalesce(p("channel_name"), "doc_id"), ("SENT_BY", "MENTIONS")),
        "File": ("file", F.coalesce(p("modified_at"), p("updated"), p("created"), F.lit("")), F.coalesce(p("title"), p("name"), p("path"), "doc_id"), ("MENTIONS",)),
    }
    source = ts = title = None
    fits = F.lit(False)
    for label, (kind, at, name, rels) in shape.items():
        here = F.col("label") == label
        source = F.when(here, kind) if source is None else source.when(here, kind)
        ts = F.when(here, at) if ts is None else ts.when(here, at)
        title = F.when(here, name) if title is None else title.when(here, name)
        fits = fits | (here & F.col("rel").isin(*rels))
    rows = docs.where(fits).select("doc_id", ts.alias("ts"), source.alias("source_type"), title.alias("title"), F.col("rel").alias("edge_kind")).distinct()
    at = times.mixed_timestamp(F.col("ts"))
    return rows.withColumn("at", at).where(F.col("at") >= F.lit(since)).orderBy(F.desc("at"), "doc_id", "edge_kind").limit(limit)


def top_topics(cluster: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    tagged = edges.where("rel = 'TAGGED' AND dst_label = 'Topic'").select(F.col("src_id").alias("doc_id"), F.col("dst_id").alias("topic_name"))
    return tagged.join(_documents(cluster, edges), "doc_id", "left_semi").distinct().groupBy("topic_name").agg(F.count("*").alias("doc_count")).orderBy(F.desc("doc_count"), "topic_name").limit(k)


def active_topics(cluster: DataFrame, nodes: DataFrame, edges: DataFrame, since: datetime, k: int = 5) -> DataFrame:
    """Topics of the person's documents dated since a time, by their number; documents without a time do not count."""
    at = times.mixed_timestamp(F.coalesce(p("date"), p("start_time"), p("last_ts"), p("first_ts"), p("modified_at"), p("updated"), p("created"), p("modification_date")))
    recent = nodes.where(at >= F.lit(since)).select(F.col("source_id").alias("src_id"))
    return top_topics(cluster, edges.where("rel <> 'TAGGED'").unionByName(edges.where("rel = 'TAGGED'").join(recent, "src_id", "left_semi").select(*edges.columns)), k)


def meeting_context(event_id: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A meeting or series with its attendees (mail address, or else name) and attachments; no row for an unknown id."""
    here = _of(nodes, "CalendarEvent", "CalendarSeries").where(F.col("source_id") == event_id).limit(1)
    named = lambda *names: nodes.select(F.col("source_id").alias("other"), F.coalesce(*map(p, names)).alias("name"))
    listed = lambda ends, name, *names: ends.join(named(*names), "other").groupBy("source_id").agg(F.array_sort(F.collect_set("name")).alias(name))
    people = edges.where(F.col("rel").isin("ORGANIZED_BY", "ATTENDED_BY", "CREATED_BY") & (F.col("dst_label") == "Person") & (F.col("src_id") == event_id))
    files = edges.where((F.col("rel") == "ATTACHED_TO") & (F.col("src_label") == "Attachment") & (F.col("dst_id") == event_id))
    attendees = listed(people.select(F.col("src_id").alias("source_id"), F.col("dst_id").alias("other")), "attendees", "email", "name")
    attachments = listed(files.select(F.col("dst_id").alias("source_id"), F.col("src_id").alias("other")), "attachments", "title", "file_id")
    rows = here.join(attendees, "source_id", "left").join(attachments, "source_id", "left")
    none = F.array().cast("array<string>")
    return rows.select(F.col("source_id").alias("event_id"), F.coalesce(p("summary"), F.lit("(no summary)")).alias("summary"), p("description").alias("description"), p("location").alias("location"), p("start_time").alias("start_time"), F.coalesce("attendees", none).alias("attendees"), F.coalesce("attachments", none).alias("attachments"))


def related_people(cluster: DataFrame, edges: DataFrame, k: int = 5) -> DataFrame:
    """Others on the person's documents, by the number of documents shared."""
    ends = both_ways(edges.where(F.col("rel").isin(*PERSON_RELATIONS))).where("label = 'Person' AND other_label <> 'Person'").select(F.col("id").alias("other_id"), F.col("other_id").alias("doc_id"))
    shared = ends.join(_documents(cluster, edges), "doc_id", "left_semi").distinct()
    others = shared.join(cluster.select(F.col("source_id").alias("other_id")), "other_id", "left_anti")
    return others.groupBy("other_id").agg(F.count("*").alias("shared_count")).orderBy(F.desc("shared_count"), "other_id").limit(k)


def open_tasks(cluster: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Open tasks that mention the person, with project and tags: flagged first, then by due date with none last."""
    ids = edges.where("rel = 'MENTIONS' AND src_label = 'Task'").join(cluster.select(F.col("source_id").alias("dst_id")), "dst_id", "left_semi").select(F.col("src_id").alias("source_id")).distinct()
    tasks = _of(nodes, "Task").join(ids, "source_id").withColumn("status", p("status")).where(is_open())
    named = nodes.select(F.col("source_id").alias("dst_id"), p("name").alias("name"))
    to = lambda rel: edges.where(F.col("rel") == rel).join(named, "dst_id").select(F.col("src_id").alias("source_id"), "name")
    tags = to("TAGGED").groupBy("source_id").agg(F.array_sort(F.collect_set("name")).alias("tags"))
    project = to("IN_PROJECT").groupBy("source_id").agg(F.min("name").alias("project"))
    rows = tasks.join(project, "source_id", "left").join(tags, "source_id", "left")
    flagged = F.coalesce(p("flagged").cast("boolean"), F.lit(False))
    return rows.select(F.col("source_id").alias("task_id"), p("name").alias("title"), "project", "tags", p("due_date").alias("due"), p("defer_date").alias("defer"), flagged.alias("flagged"), F.coalesce(p("modification_date"), p("creation_date"), F.lit("")).alias("changed")).orderBy(F.desc("flagged"), F.asc_nulls_last("due"), "task_id")


def files_mentioning(cluster: DataFrame, nodes: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    ids = edges.where("rel = 'MENTIONS' AND src_label = 'File'").join(cluster.select(F.col("source_id").alias("dst_id")), "dst_id", "left_semi").select(F.col("src_id").alias("source_id")).distinct()
    files = _of(nodes, "File").join(ids, "source_id")
    return files.select("source_id", F.coalesce(p("title"), p("name"), p("path")).alias("title"), F.coalesce(p("modified_at"), p("updated"), p("created")).alias("mtime")).orderBy(F.desc_nulls_first("mtime"), "source_id").limit(k)


def outstanding_threads(cluster: DataFrame, nodes: DataFrame, edges: DataFrame, since: datetime, limit: int = 10) -> DataFrame:
    """Threads whose last mail is the person's."""
    part = edges.where("rel = 'PART_OF' AND src_label = 'Email'").select(F.col("src_id").alias("mail"), F.col("dst_id").alias("thread"))
    mails = _of(nodes, "Email").select(F.col("source_id").alias("mail"), p("date").alias("date"), p("subject").alias("subject"))
    sent = edges.where("rel = 'SENT'").select(F.col("src_id").alias("source_id"), F.col("dst_id").alias("mail"))
    dated = part.join(mails, "mail").withColumn("last", F.max("date").over(Window.partitionBy("thread"))).where("date = last")
    own = dated.join(sent, "mail").join(cluster, "source_id", "left_semi")
    return own.where(times.mixed_timestamp(F.col("date")) >= F.lit(since)).groupBy("thread").agg(F.max("date").alias("last_date"), F.max_by("subject", F.struct("date", "mail")).alias("subject")).orderBy(F.desc("last_date"), "thread").limit(limit)


def unanswered_mentions(cluster: DataFrame, nodes: DataFrame, edges: DataFrame, me: DataFrame) -> DataFrame:
    """Chats in which the person names me and that I did not follow up in the channel."""
    chats = _of(nodes, "SlackMessage").select("source_id", p("channel_id").alias("channel"), p("first_ts").cast("decimal(20,6)").alias("first_ts"), p("last_ts").cast("decimal(20,6)").alias("last_ts"))
    by = lambda rel, who: edges.where((F.col("rel") == rel) & (F.col("src_label") == "SlackMessage")).join(who.select(F.col("source_id").alias("dst_id")), "dst_id", "left_semi").select(F.col("src_id").alias("source_id")).distinct()
    asked = chats.join(by("SENT_BY", cluster), "source_id", "left_semi").join(by("MENTIONS", me), "source_id", "left_semi")
    mine = chats.join(by("SENT_BY", me), "source_id", "left_semi").groupBy("channel").agg(F.max("first_ts").alias("reply"))
    return asked.join(mine, "channel", "left").where(F.col("reply").isNull() | (F.col("reply") <= F.col("last_ts"))).select("source_id", "channel", "last_ts")


def source_count(cluster: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In how many of the kinds of source the person occurs."""
    kinds = {"gmail": "Email", "google_calendar": "CalendarEvent", "slack": "SlackMessage", "omnifocus": "Task", "file": "File"}
    docs = person_documents(cluster, edges).join(nodes.select(F.col("source_id").alias("doc_id"), "label"), "doc_id")
    each = docs.agg(*(F.coalesce(F.max(F.when(F.col("label") == label, 1)), F.lit(0)).alias(k) for k, label in kinds.items()))
    return each.withColumn("sources", sum((F.col(k) for k in kinds), F.lit(0)))


def total_interactions(cluster: DataFrame, edges: DataFrame) -> DataFrame:
    ends = both_ways(edges.where("rel <> 'SAME_AS'")).where("other_label <> 'Person'").join(cluster.select(F.col("source_id").alias("id")), "id", "left_semi")
    return ends.agg(F.count_distinct("other_id").alias("total"))


def profile(cluster: DataFrame, nodes: DataFrame, edges: DataFrame, since: datetime, limit: int = 10) -> dict[str, DataFrame]:
    """All sections of a person's profile."""
    return {
        "recent_interactions": interactions(cluster, nodes, edges, since, limit),
        "top_topics": top_topics(cluster, edges),
        "related_people": related_people(cluster, edges),
        "open_tasks": open_tasks(cluster, nodes, edges),
        "files": files_mentioning(cluster, nodes, edges),
        "total": total_interactions(cluster, edges),
    }


def events_for_day(nodes: DataFrame, edges: DataFrame, day: date, tz: str = "UTC", account: str | None = None, limit: int = 100) -> DataFrame:
    """The local day's events with organiser and attendees, a recurring one's from its series; filtered exactly before the limit."""
    here = _of(nodes, "CalendarEvent").where(times.starts_in_window(p("start_time"), day, tz))
    if account is not None:
        here = here.where(p("account") == account)
    events = here.select("source_id", p("summary").alias("title"), p("start_time").alias("start_ts"), p("end_time").alias("end_ts"), p("location").alias("location"), p("account").alias("account")).orderBy("start_ts", "source_id").limit(limit)
    owner = edges.where("rel = 'INSTANCE_OF'").select(F.col("src_id").alias("source_id"), F.col("dst_id").alias("owner"))
    owners = events.select("source_id", F.col("source_id").alias("owner")).unionByName(events.select("source_id").join(owner, "source_id"))
    people = _of(nodes, "Person").select(F.col("source_id").alias("person"), F.coalesce(p("is_self").cast("boolean"), F.lit(False)).alias("is_self"))
    ends = edges.where(F.col("rel").isin("ATTENDED_BY", "ORGANIZED_BY")).select(F.col("src_id").alias("owner"), "rel", F.col("dst_id").alias("person"))
    who = owners.join(ends, "owner").join(people, "person")
    grouped = who.groupBy("source_id").agg(
        F.min(F.when(F.col("rel") == "ORGANIZED_BY", F.col("person"))).alias("organizer"),
        F.array_sort(F.collect_set(F.when((F.col("rel") == "ATTENDED_BY") & ~F.col("is_self"), F.col("person")))).alias("attendees"),
        F.count_if((F.col("rel") == "ATTENDED_BY") & F.col("is_self")).alias("self_n"),
    )
    rows = events.join(grouped, "source_id", "left")
    alone = (F.coalesce("self_n", F.lit(0)) > 0) & (F.size(F.coalesce("attendees", F.array().cast("array<string>"))) == 0)
    return rows.withColumn("is_self_only", alone).drop("self_n").orderBy("start_ts", "source_id")


def attendee_clusters(events: DataFrame, members: DataFrame) -> DataFrame:
    """(event_id, attendee, person): each attendee's whole cluster; ``members`` is (id, component)."""
    who = events.select(F.col("source_id").alias("event_id"), F.explode("attendees").alias("attendee"))
    of = who.join(members.select(F.col("id").alias("attendee"), "component"), "attendee", "left")
    rest = members.select(F.col("id").alias("person"), "component")
    return of.join(rest, "component", "left").select("event_id", "attendee", F.coalesce("person", "attendee").alias("person")).unionByName(who.select("event_id", "attendee", F.col("attendee").alias("person"))).distinct()


def _ranked(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("event_id").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def linked_tasks(clusters: DataFrame, nodes: DataFrame, edges: DataFrame, since: str | None = None, k: int = 5) -> DataFrame:
    """Up to ``k`` open tasks for each event that mention any attendee: one join for all events."""
    people = clusters.select("event_id", "person").distinct()
    about = edges.where("rel = 'MENTIONS' AND src_label = 'Task'").select(F.col("src_id").alias("source_id"), F.col("dst_id").alias("person"))
    ids = about.join(people, "person").select("event_id", "source_id").distinct()
    tasks = _of(nodes, "Task").withColumn("status", p("status")).where(is_open())
    if since is not None:
        tasks = tasks.where(F.coalesce(p("modification_date"), p("creation_date"), F.lit("")) >= since)
    rows = ids.join(tasks, "source_id").select("event_id", "source_id", p("name").alias("title"), p("due_date").alias("due"), F.coalesce(p("flagged").cast("boolean"), F.lit(False)).alias("flagged"))
    return _ranked(rows, k, F.desc("flagged"), F.asc_nulls_last("due"), F.asc("source_id"))


def linked_notes(events: DataFrame, chunks: DataFrame, parents: DataFrame, clusters: DataFrame, k: int = 5, types: tuple[str, ...] = ("files", "obsidian")) -> DataFrame:
    """Notes most like each event's title (events: source_id, vector; chunks: source_id, source_type, vector), best chunk of each, those that mention an attendee first."""
    e = events.select(F.col("source_id").alias("event_id"), F.col("vector").alias("ev"))  # a day's events
    scored = chunks.where(F.col("source_type").isin(*types)).join(F.broadcast(e)).withColumn("score", V.cosine(F.col("ev"), F.col("vector")))
    best = scored.groupBy("event_id", "source_id").agg(F.max("score").alias("score"))
    near = _ranked(best, max(10, 5 * k), F.desc("score"), F.asc("source_id")).drop("rank")
    shared = parents.join(clusters.select("event_id", "person").distinct(), "person").select("event_id", "source_id").distinct().withColumn("overlap", F.lit(True))
    return _ranked(near.join(shared, ["event_id", "source_id"], "left").withColumn("overlap", F.coalesce("overlap", F.lit(False))), k, F.desc("overlap"), F.desc("score"), F.asc("source_id"))


def recent_thread(clusters: DataFrame, nodes: DataFrame, edges: DataFrame, since: datetime | None = None) -> DataFrame:
    """For each event the newest mail thread or chat window on which every attendee's cluster occurs: relational division by counting."""
    mail = _of(nodes, "Email").select(F.col("source_id").alias("doc"), times.mixed_timestamp(p("date")).alias("at"))
    chat = _of(nodes, "SlackMessage").select(F.col("source_id").alias("doc"), times.mixed_timestamp(F.coalesce(p("last_ts"), p("first_ts"))).alias("at"))
    of_thread = edges.where("rel = 'PART_OF' AND src_label = 'Email'").select(F.col("src_id").alias("doc"), F.col("dst_id").alias("unit"))
    units = mail.join(of_thread, "doc").select(F.lit("email").alias("kind"), "unit", "doc", "at").unionByName(chat.select(F.lit("slack").alias("kind"), F.col("doc").alias("unit"), "doc", "at"))
    if since is not None:
        units = units.where(F.col("at") >= F.lit(since))
    ends = both_ways(edges.where(F.col("rel").isin("SENT", "TO", "SENT_BY", "MENTIONS"))).where("label = 'Person'")
    fits = ((F.col("kind") == "email") & F.col("rel").isin("SENT", "TO")) | ((F.col("kind") == "slack") & F.col("rel").isin("SENT_BY", "MENTIONS"))
    people = units.join(ends.select(F.col("id").alias("person"), "rel", F.col("other_id").alias("doc")), "doc").where(fits).select("kind", "unit", "person").distinct()
    need = clusters.groupBy("event_id").agg(F.count_distinct("attendee").alias("need"))
    have = people.join(clusters, "person").groupBy("event_id", "kind", "unit").agg(F.count_distinct("attendee").alias("have"))
    last = units.groupBy("kind", "unit").agg(F.max("at").alias("last_ts"))
    full = have.join(need, "event_id").where("have = need").join(last, ["kind", "unit"])
    return _ranked(full, 1, F.desc("last_ts"), F.asc("unit")).select("event_id", "kind", "unit", "last_ts")


def itinerary(nodes: DataFrame, edges: DataFrame, members: DataFrame, day: date, tz: str = "UTC", account: str | None = None, since: str | None = None) -> dict[str, DataFrame]:
    """A day's events with linked tasks and threads, all events at once."""
    events = events_for_day(nodes, edges, day, tz, account)
    clusters = attendee_clusters(events, members)
    return {"events": events, "tasks": linked_tasks(clusters, nodes, edges, since), "threads": recent_thread(clusters, nodes, edges)}


def last_messages(messages: DataFrame, by: str, *order: Column, n: int = 3) -> DataFrame:
    """The last ``n`` rows of each group."""
    return messages.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def brief(events: DataFrame, tasks: DataFrame, threads: DataFrame) -> DataFrame:
    """A text for each event: title, time, attendees, tasks, thread."""
    listed = tasks.groupBy("event_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda t: F.concat(F.lit("  - "), t["title"])), "\n").alias("task_text"))
    rows = events.join(listed.withColumnRenamed("event_id", "source_id"), "source_id", "left").join(threads.select(F.col("event_id").alias("source_id"), "unit"), "source_id", "left")
    text = F.concat_ws("\n", F.concat("title", F.lit(" ("), "start_ts", F.lit(")")), F.concat(F.lit("With: "), F.array_join("attendees", ", ")), F.concat(F.lit("Tasks:\n"), "task_text"), F.concat(F.lit("Thread: "), "unit"))
    return rows.select("source_id", text.alias("brief"))


# Characters shown of a chat and of a meeting's description.
SHOWN_CHAT, SHOWN_DESCRIPTION = 200, 1000


def _shown(text: Column, most: int) -> Column:
    kept = F.trim(F.coalesce(text, F.lit("")), F.lit(" \t\r\n"))
    return F.when(F.length(kept) > most, F.concat(F.rtrim(F.substring(kept, 1, most), F.lit(" \t\r\n")), F.lit("…"))).otherwise(kept)


def _section(rows: DataFrame, pos: int, head: Column | str, line: Column, *order: Column | str, empty: str | None = "(none)") -> DataFrame:
    """One row (pos, text): a heading, which may count the rows as {n}, and a line for each of a brief's few rows; without rows ``empty``, or no section at all."""
    numbered = rows.select(F.row_number().over(Window.orderBy(*order)).alias("k"), line.alias("line"))
    whole = numbered.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("body"), F.count("*").alias("n"))
    title = F.replace(head if isinstance(head, Column) else F.lit(head), F.lit("{n}"), F.col("n").cast("string"))
    body = F.when(F.col("n") > 0, F.col("body")).otherwise(F.lit(empty))
    return whole.where(F.lit(empty is not None) | (F.col("n") > 0)).select(F.lit(pos).alias("pos"), F.concat(title, F.lit("\n"), body).alias("text"))


def brief_text(name: str, mail: str, sources: DataFrame, tasks: DataFrame, threads: DataFrame, chats: DataFrame, topics: DataFrame, since_label: str, note: str | None = None, meeting: DataFrame | None = None) -> DataFrame:
    """The pre-meeting brief as one text. Sections are the rows of ``source_count``, ``open_tasks``, ``outstanding_threads``, ``unanswered_mentions`` (with channel, last_ts, text),
    ``active_topics`` and ``meeting_context``; a person's note and the meeting are left out where there is none."""
    who = f"{name or '(unnamed)'}{f' <{mail}>' if mail else ''} — "
    some = lambda column, before, after="": F.when(F.coalesce(column, F.lit("")) != "", F.concat(F.lit(before), column, F.lit(after)))
    task = F.concat_ws(" ", F.concat(F.lit("- "), "title"), some(F.col("project"), "(project: ", ")"), some(F.col("due"), "due "), F.when(F.col("flagged"), "[flagged]"))
    said = _shown(F.regexp_replace(F.col("text"), "\n", " "), SHOWN_CHAT)
    chat = F.concat(F.lit("- #"), "channel", F.lit(" @ "), F.col("last_ts").cast("string"), F.when(said != "", F.concat(F.lit(" — "), said)).otherwise(""))
    parts = [
        _section(sources, 0, "[Identity]", F.concat(F.lit(who), F.col("sources").cast("string"), F.lit(" sources")), F.lit(1)),
        _section(tasks, 1, "[Open OmniFocus tasks ({n})]", task, F.desc("flagged"), F.asc_nulls_last("due"), F.col("task_id")),
        _section(threads, 2, f"[Outstanding email threads (last {since_label}, {{n}})]", F.concat(F.lit("- "), "subject", F.lit(" (last reply "), "last_date", F.lit(")")), F.desc("last_date"), F.col("thread")),
        _section(chats, 3, f"[Unresolved Slack mentions of you (last {since_label}, {{n}})]", chat, F.desc("last_ts"), F.col("channel")),
        _section(topics, 4, f"[Top active topics (last {since_label})]", F.concat(F.lit("- "), "topic_name", F.lit(" ("), F.col("doc_count").cast("string"), F.lit(" docs)")), F.desc("doc_count"), F.col("topic_name")),
    ]
    spark = sources.sparkSession
    if note is not None:
        parts.append(spark.range(1).select(F.lit(5).alias("pos"), F.lit("[Obsidian People note]\n" + note.strip()).alias("text")))
    if meeting is not None:
        listed = lambda c, before: F.when(F.size(c) > 0, F.concat(F.lit(before), F.array_join(c, ", ")))
        lines = F.concat_ws("\n", F.concat(F.lit("Event: "), "summary"), some(F.col("start_time"), "When: "), some(F.col("location"), "Where: "), listed("attendees", "Attendees: "), some(_shown(F.col("description"), SHOWN_DESCRIPTION), "Description:\n"), listed("attachments", "Attachments: "))
        parts.append(_section(meeting, 6, "[Upcoming meeting context]", lines, F.col("event_id"), empty=None))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("text"))
