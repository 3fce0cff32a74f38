"""More queries over the driver's tables: each calls one operator that ``queries`` does not, with DuckDB SQL written from the operator's rule."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import driver_views as D
from .functions import answers, text as T, times
from .operators import density, filters, graph, identity, neighbours, queue as Q, vector_index, writers
from .plans import activity, people
from .queries import COS, VEC, query, ts
from .sources import parsers, snapshots
from .streaming import buckets, labels
from .tables import remove, shared_folder, written

#: The stored form of a time, in Spark and in DuckDB.
SPARK_ISO = "date_format({0}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"
DUCK_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%SZ')"
LONG_AGO = datetime.datetime(1990, 1, 1, tzinfo=datetime.timezone.utc)


def at(year: int, month: int, day: int) -> datetime.datetime:
    return datetime.datetime(year, month, day, tzinfo=datetime.timezone.utc)


def _nodes(df: DataFrame, label: str, source_id: str, **props: str) -> DataFrame:
    pairs = [x for name, value in props.items() for x in (F.lit(name), F.expr(value).cast("string"))]
    return df.select(F.lit(label).alias("label"), F.expr(source_id).alias("source_id"), F.create_map(*pairs).alias("props"))


def _edges(df: DataFrame, src_label: str, src_id: str, rel: str, dst_label: str, dst_id: str) -> DataFrame:
    return df.select(F.lit(src_label).alias("src_label"), F.expr(src_id).alias("src_id"), F.lit(rel).alias("rel"), F.lit(dst_label).alias("dst_label"), F.expr(dst_id).alias("dst_id"))


def _cluster(spark, *ids: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ids], "source_id string")


# --- a person: mails are orders, tasks are parts, files are documents


def _mails(spark, sf_dir) -> DataFrame:
    return _nodes(D.table(spark, sf_dir, "orders"), "Email", "concat('mail:', o_orderkey)", date=SPARK_ISO.format("o_orderdate"), subject="concat('Order ', o_orderkey)")


def _tasks(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    part = D.table(spark, sf_dir, "part")
    nodes = _nodes(part, "Task", "concat('todo:', p_partkey)", name="p_name", status="IF(p_size % 3 = 0, 'completed', 'active')", due_date="IF(p_size % 4 = 0, null, concat('1996-02-', lpad(p_size % 28 + 1, 2, '0')))", flagged="p_size > 40")
    tags = _nodes(part.select("p_brand").distinct(), "Tag", "concat('tag:', p_brand)", name="p_brand")
    projects = _nodes(part.selectExpr("p_size % 7 AS g").distinct(), "Project", "concat('proj:', g)", name="concat('Project ', g)")
    about = _edges(part, "Task", "concat('todo:', p_partkey)", "MENTIONS", "Person", "concat('supp:', p_partkey % 50 + 1)")
    tagged = _edges(part, "Task", "concat('todo:', p_partkey)", "TAGGED", "Tag", "concat('tag:', p_brand)")
    within = _edges(part, "Task", "concat('todo:', p_partkey)", "IN_PROJECT", "Project", "concat('proj:', p_size % 7)")
    return nodes.unionByName(tags).unionByName(projects), about.unionByName(tagged).unionByName(within)


def _files(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    docs = D.table(spark, sf_dir, "documents")
    nodes = _nodes(docs, "File", "concat('doc:', doc_id)", title="concat('Doc ', doc_id)", updated="IF(doc_id % 9 = 0, null, concat('2024-01-', lpad(doc_id % 28 + 1, 2, '0')))")
    return nodes, _edges(docs, "File", "concat('doc:', doc_id)", "MENTIONS", "Person", "concat('cust:', doc_id % 20)")


DUE = "CASE WHEN p_size % 4 <> 0 THEN '1996-02-' || lpad((p_size % 28 + 1)::VARCHAR, 2, '0') END"


@query(f"""SELECT doc_id, ts, 'gmail' AS source_type, title, edge_kind FROM (
SELECT 'mail:' || o_orderkey AS doc_id, {DUCK_ISO.format('o_orderdate')} AS ts, 'Order ' || o_orderkey AS title, 'SENT' AS edge_kind FROM orders WHERE o_custkey = 7
UNION SELECT 'mail:' || o_orderkey, {DUCK_ISO.format('o_orderdate')}, 'Order ' || o_orderkey, 'MENTIONS' FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey = 3)
WHERE ts >= '1995-01-01T00:00:00Z' ORDER BY ts DESC, doc_id, edge_kind LIMIT 10""")
def person_interactions(spark, sf_dir):
    return people.interactions(_cluster(spark, "cust:7", "supp:3"), _mails(spark, sf_dir), D.edges(spark, sf_dir), at(1995, 1, 1)).select("doc_id", "ts", "source_type", "title", "edge_kind")


@query("SELECT 'doc:' || doc_id AS source_id, 'Doc ' || doc_id AS title, CASE WHEN doc_id % 9 <> 0 THEN '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') END AS mtime FROM documents WHERE doc_id % 20 IN (3, 7) ORDER BY mtime DESC NULLS FIRST, source_id LIMIT 10")
def files_of_person(spark, sf_dir):
    return people.files_mentioning(_cluster(spark, "cust:3", "cust:7"), *_files(spark, sf_dir))


@query(f"SELECT 'todo:' || p_partkey AS task_id, p_name AS title, 'Project ' || (p_size % 7) AS project, p_brand AS tags, {DUE} AS due, p_size > 40 AS flagged FROM part WHERE p_partkey % 50 + 1 IN (3, 7) AND p_size % 3 <> 0")
def open_tasks_of_person(spark, sf_dir):
    rows = people.open_tasks(_cluster(spark, "supp:3", "supp:7"), *_tasks(spark, sf_dir))
    return rows.select("task_id", "title", "project", F.array_join("tags", ",").alias("tags"), "due", "flagged")


@query(f"""WITH m AS (SELECT 'thread:' || (o_orderkey % 200) AS thread, 'mail:' || o_orderkey AS mail, {DUCK_ISO.format('o_orderdate')} AS date, 'Order ' || o_orderkey AS subject, o_custkey FROM orders),
l AS (SELECT *, max(date) OVER (PARTITION BY thread) AS last FROM m)
SELECT thread, max(date) AS last_date, arg_max(subject, mail) AS subject FROM l JOIN customer ON c_custkey = o_custkey WHERE c_nationkey IN (3, 4, 5) AND date = last GROUP BY thread ORDER BY last_date DESC, thread LIMIT 10""")
def threads_awaiting_answer(spark, sf_dir):
    part_of = _edges(D.table(spark, sf_dir, "orders"), "Email", "concat('mail:', o_orderkey)", "PART_OF", "Thread", "concat('thread:', o_orderkey % 200)")
    cluster = D.table(spark, sf_dir, "customer").where("c_nationkey IN (3, 4, 5)").selectExpr("concat('cust:', c_custkey) AS source_id")
    return people.outstanding_threads(cluster, _mails(spark, sf_dir), D.edges(spark, sf_dir).unionByName(part_of), LONG_AGO)


@query("""SELECT 'chat:' || event_id AS source_id, (event_id % 3)::VARCHAR AS channel FROM events e WHERE user_id % 10 = 5 AND event_id % 5 = 1
AND NOT EXISTS (SELECT 1 FROM events r WHERE r.user_id = 1 AND r.event_id % 3 = e.event_id % 3 AND r.ts > e.ts)""")
def chats_without_reply(spark, sf_dir):
    events = D.table(spark, sf_dir, "events")
    micros = "unix_micros(cast(ts AS timestamp))"
    when = f"concat({micros} div 1000000, '.', lpad({micros} % 1000000, 6, '0'))"
    nodes = _nodes(events, "SlackMessage", "concat('chat:', event_id)", channel_id="event_id % 3", first_ts=when, last_ts=when)
    sent = _edges(events, "SlackMessage", "concat('chat:', event_id)", "SENT_BY", "Person", "concat('user:', user_id)")
    named = _edges(events, "SlackMessage", "concat('chat:', event_id)", "MENTIONS", "Person", "concat('user:', event_id % 5)")
    cluster = events.where("user_id % 10 = 5").selectExpr("concat('user:', user_id) AS source_id").distinct()
    return people.unanswered_mentions(cluster, nodes, sent.unionByName(named), _cluster(spark, "user:1")).select("source_id", "channel")


@query("""SELECT gmail, 0 AS google_calendar, 0 AS slack, omnifocus, file, gmail + omnifocus + file AS sources FROM (SELECT
((SELECT count(*) FROM orders WHERE o_custkey = 7) + (SELECT count(*) FROM lineitem WHERE l_suppkey = 3) > 0)::INT AS gmail, ((SELECT count(*) FROM part WHERE p_partkey % 50 + 1 = 3) > 0)::INT AS omnifocus, ((SELECT count(*) FROM documents WHERE doc_id % 20 = 7) > 0)::INT AS file)""")
def source_presence(spark, sf_dir):
    (tasks, about), (files, named) = _tasks(spark, sf_dir), _files(spark, sf_dir)
    return people.source_count(_cluster(spark, "cust:7", "supp:3"), _mails(spark, sf_dir).unionByName(tasks).unionByName(files), D.edges(spark, sf_dir).unionByName(about).unionByName(named))


@query("SELECT p_brand AS topic_name, count(DISTINCT l_orderkey) AS doc_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_custkey = 7 AND o_orderdate >= TIMESTAMP '1995-06-01' GROUP BY 1 ORDER BY doc_count DESC, topic_name LIMIT 5")
def active_topics_of_person(spark, sf_dir):
    return people.active_topics(_cluster(spark, "cust:7"), _mails(spark, sf_dir), D.edges(spark, sf_dir), at(1995, 6, 1))


@query(f"""SELECT 'cal:' || o_orderkey AS event_id, 'Order ' || o_orderkey AS summary, o_orderstatus AS location, {DUCK_ISO.format('o_orderdate')} AS start_time,
coalesce((SELECT array_to_string(list_sort(list_distinct(list(s_name))), '|') FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_orderkey = 7), '') AS attendees,
coalesce((SELECT array_to_string(list_sort(list_distinct(list(p_name))), '|') FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_orderkey = 7), '') AS attachments FROM orders WHERE o_orderkey = 7""")
def meeting_context(spark, sf_dir):
    t = lambda name: D.table(spark, sf_dir, name)
    meetings = _nodes(t("orders"), "CalendarSeries", "concat('cal:', o_orderkey)", summary="concat('Order ', o_orderkey)", location="o_orderstatus", start_time=SPARK_ISO.format("o_orderdate"))
    persons = _nodes(t("supplier"), "Person", "concat('supp:', s_suppkey)", name="s_name")
    files = _nodes(t("part"), "Attachment", "concat('att:', p_partkey)", title="p_name")
    there = _edges(t("lineitem"), "CalendarSeries", "concat('cal:', l_orderkey)", "ATTENDED_BY", "Person", "concat('supp:', l_suppkey)")
    hung = _edges(t("lineitem"), "Attachment", "concat('att:', l_partkey)", "ATTACHED_TO", "CalendarSeries", "concat('cal:', l_orderkey)")
    rows = people.meeting_context("cal:7", meetings.unionByName(persons).unionByName(files), there.unionByName(hung))
    return rows.select("event_id", "summary", "location", "start_time", F.array_join("attendees", "|").alias("attendees"), F.array_join("attachments", "|").alias("attachments"))


# --- a day: calendar events are events, people their users


def _day(spark, sf_dir) -> DataFrame:
    events = D.table(spark, sf_dir, "events")
    users = events.select("user_id").unionByName(events.selectExpr("event_id % 10 AS user_id")).distinct()
    nodes = _nodes(events, "CalendarEvent", "concat('event:', event_id)", summary="event_type", start_time=SPARK_ISO.format("ts")).unionByName(_nodes(users, "Person", "concat('user:', user_id)", is_self="user_id = 3"))
    there = _edges(events, "CalendarEvent", "concat('event:', event_id)", "ATTENDED_BY", "Person", "concat('user:', user_id)")
    owned = _edges(events, "CalendarEvent", "concat('event:', event_id)", "ORGANIZED_BY", "Person", "concat('user:', event_id % 10)")
    return people.events_for_day(nodes, there.unionByName(owned), datetime.date(2024, 1, 10))


def _day_clusters(spark, sf_dir) -> DataFrame:
    members = D.table(spark, sf_dir, "events").selectExpr("concat('user:', user_id) AS id", "user_id % 40 AS component").distinct()
    return people.attendee_clusters(_day(spark, sf_dir), members)


DAY = f"day AS (SELECT 'event:' || event_id AS source_id, event_type AS title, {DUCK_ISO.format('ts')} AS start_ts, event_id, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' ORDER BY start_ts, source_id LIMIT 100)"
DAY_CLUSTERS = f"{DAY}, clusters AS (SELECT DISTINCT d.source_id AS event_id, 'user:' || d.user_id AS attendee, 'user:' || u.user_id AS person FROM day d JOIN (SELECT DISTINCT user_id FROM events) u ON u.user_id % 40 = d.user_id % 40 WHERE d.user_id <> 3)"


@query(f"WITH {DAY} SELECT source_id, title, start_ts, 'user:' || (event_id % 10) AS organizer, CASE WHEN user_id = 3 THEN '' ELSE 'user:' || user_id END AS attendees, user_id = 3 AS is_self_only FROM day")
def events_of_day(spark, sf_dir):
    return _day(spark, sf_dir).select("source_id", "title", "start_ts", "organizer", F.array_join("attendees", ",").alias("attendees"), "is_self_only")


@query(f"WITH {DAY_CLUSTERS} SELECT * FROM clusters")
def attendees_of_day(spark, sf_dir):
    return _day_clusters(spark, sf_dir)


@query(f"""WITH {DAY_CLUSTERS}, t AS (SELECT DISTINCT c.event_id, 'todo:' || p_partkey AS source_id, p_name AS title, {DUE} AS due, p_size > 40 AS flagged FROM part JOIN clusters c ON c.person = 'user:' || (p_partkey % 50) WHERE p_size % 3 <> 0)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY flagged DESC, due ASC NULLS LAST, source_id)::INT AS rank FROM t) WHERE rank <= 5""")
def tasks_of_day(spark, sf_dir):
    about = _edges(D.table(spark, sf_dir, "part"), "Task", "concat('todo:', p_partkey)", "MENTIONS", "Person", "concat('user:', p_partkey % 50)")
    return people.linked_tasks(_day_clusters(spark, sf_dir), _tasks(spark, sf_dir)[0], about).select("event_id", "source_id", "title", "due", "flagged", "rank")


@query("""WITH m AS (SELECT 'thread:' || (o_orderkey % 300) AS unit, o_custkey AS c, o_orderdate AS d FROM orders), w AS (SELECT n_nationkey AS n, unnest([n_nationkey + 1, n_nationkey + 2]) AS c FROM nation),
h AS (SELECT n, unit, count(DISTINCT m.c) AS k FROM m JOIN w ON m.c = w.c GROUP BY 1, 2), x AS (SELECT unit, max(d) AS last FROM m GROUP BY 1)
SELECT event_id, 'email' AS kind, unit FROM (SELECT 'n' || n AS event_id, h.unit, row_number() OVER (PARTITION BY n ORDER BY last DESC, h.unit) AS r FROM h JOIN x ON h.unit = x.unit WHERE k = 2) WHERE r = 1""")
def thread_of_attendees(spark, sf_dir):
    part_of = _edges(D.table(spark, sf_dir, "orders"), "Email", "concat('mail:', o_orderkey)", "PART_OF", "Thread", "concat('thread:', o_orderkey % 300)")
    who = D.table(spark, sf_dir, "nation").selectExpr("concat('n', n_nationkey) AS event_id", "explode(array(n_nationkey + 1, n_nationkey + 2)) AS c").selectExpr("event_id", "concat('cust:', c) AS attendee", "concat('cust:', c) AS person")
    return people.recent_thread(who, _mails(spark, sf_dir), D.edges(spark, sf_dir).unionByName(part_of)).select("event_id", "kind", "unit")


@query(f"""WITH {VEC}, e AS (SELECT * FROM v ORDER BY source_id LIMIT 5),
s AS (SELECT e.source_id AS event_id, v.source_id, v.vec_id % 10 = e.vec_id AS overlap, {COS.format(a='e.vector', b='v.vector')} AS score FROM e, v WHERE v.source_type IN ('t0', 't1', 't2', 't3')),
n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, source_id) AS r FROM s) WHERE r <= 25)
SELECT event_id, source_id, overlap, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY overlap DESC, score DESC, source_id)::INT AS rank FROM n) WHERE rank <= 5""")
def notes_of_day(spark, sf_dir):
    v = D.vectors(spark, sf_dir)
    parents = v.selectExpr("source_id", "concat('user:', vec_id % 10) AS person")
    clusters = v.selectExpr("source_id AS event_id", "concat('user:', vec_id) AS person")
    rows = people.linked_notes(v.orderBy("source_id").limit(5), v, parents, clusters, types=("t0", "t1", "t2", "t3"))
    return rows.select("event_id", "source_id", "overlap", F.round("score", 6).alias("score"), "rank")


@query("SELECT count(*) AS new_topics FROM part WHERE TIMESTAMP '1996-01-01' + to_hours(p_partkey) BETWEEN TIMESTAMP '1996-01-03' AND TIMESTAMP '1996-02-01'")
def new_topic_count(spark, sf_dir):
    topics = D.table(spark, sf_dir, "part").selectExpr("p_name AS name", "timestamp_ntz'1996-01-01' + make_dt_interval(0, cast(p_partkey AS int)) AS created_at")
    return activity.new_topics(topics, ts("1996-01-03"), ts("1996-02-01"))


# --- writers


@query("""SELECT 'cust:' || o_custkey AS src_id, 'mail:' || o_orderkey AS dst_id FROM orders WHERE NOT (o_orderkey % 2 = 0 AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0))
UNION ALL SELECT 'cust:' || o_custkey, 'new:' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0""")
def replaced_hints(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders")
    old = _edges(o, "Person", "concat('cust:', o_custkey)", "SENT", "Email", "concat('mail:', o_orderkey)").withColumn("hint", F.substring("dst_id", 6, 20).cast("long") % 2 == 0)
    new = _edges(o.where("o_orderkey % 3 = 0"), "Person", "concat('cust:', o_custkey)", "SENT", "Email", "concat('new:', o_orderkey)").withColumn("hint", F.lit(True))
    return writers.replace_hints(old, new).select("src_id", "dst_id")


@query("""SELECT 'nodes' AS kept, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'edges', count(*) FROM documents WHERE doc_id % 3 <> 0 AND (doc_id + 1) % 3 <> 0
UNION ALL SELECT 'chunks', count(*) FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'vectors', count(*) FROM documents WHERE doc_id % 3 <> 0""")
def deleted_documents(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    chunks = docs.selectExpr("concat('doc:', doc_id) AS source_id", "0 AS chunk_index")
    linked = _edges(docs, "File", "concat('doc:', doc_id)", "LINKS_TO", "File", "concat('doc:', doc_id + 1)")
    # ids of documents that are not there either: the last one's link
    gone = docs.selectExpr("explode(array(doc_id, doc_id + 1)) AS id").where("id % 3 = 0").selectExpr("concat('doc:', id) AS source_id")
    left = writers.delete_documents(gone, _files(spark, sf_dir)[0], linked, chunks, chunks)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(kept).alias("kept"), "n") for kept, df in zip(("nodes", "edges", "chunks", "vectors"), left)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("""SELECT src_id, dst_id FROM (SELECT DISTINCT 'mail:' || l_orderkey AS src_id, 'supp:' || l_suppkey AS dst_id FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <= 2)
EXCEPT SELECT 'mail:' || l_orderkey, 'supp:' || l_suppkey FROM lineitem WHERE l_linenumber <= 2)""")
def stale_edges(spark, sf_dir):
    shape = lambda df: df.selectExpr("concat('mail:', l_orderkey) AS src_id", "'MENTIONS' AS rel", "concat('supp:', l_suppkey) AS dst_id").distinct()
    lines = D.table(spark, sf_dir, "lineitem")
    return writers.stale_edges(shape(lines), shape(lines.where("l_linenumber <= 2"))).select("src_id", "dst_id")


@query("SELECT email, name FROM (SELECT 'u' || (c_custkey % 400) AS email, c_mktsegment AS name, row_number() OVER (PARTITION BY c_custkey % 400 ORDER BY length(c_mktsegment) DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def person_names(spark, sf_dir):
    return writers.person_names(D.table(spark, sf_dir, "customer").selectExpr("concat('u', c_custkey % 400) AS email", "c_mktsegment AS name", "c_custkey AS seq"))


@query("""SELECT 'doc:' || doc_id AS source_id, lang AS a, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE source END AS b, CASE WHEN doc_id % 3 = 0 THEN n_chars::VARCHAR END AS c, doc_id % 3 = 0 AS indexed FROM documents
UNION ALL SELECT 'item:' || item_id, NULL, 'new', length(text)::VARCHAR, true FROM benchmark""")
def upserted_nodes(spark, sf_dir):
    docs, items = D.table(spark, sf_dir, "documents"), D.table(spark, sf_dir, "benchmark")
    old = _nodes(docs, "File", "concat('doc:', doc_id)", a="lang", b="source").withColumn("indexed_at", F.lit(None).cast("timestamp_ntz"))
    new = _nodes(docs.where("doc_id % 3 = 0"), "File", "concat('doc:', doc_id)", b="'new'", c="n_chars").unionByName(_nodes(items, "File", "concat('item:', item_id)", b="'new'", c="length(text)"))
    rows = writers.upsert_nodes(old, new, ts("2024-06-01"))
    prop = lambda name: F.try_element_at("props", F.lit(name)).alias(name)
    return rows.select("source_id", prop("a"), prop("b"), prop("c"), F.col("indexed_at").isNotNull().alias("indexed"))


@query("SELECT DISTINCT p_name AS src_id, CASE p_size % 4 WHEN 0 THEN 'MEETS_WITH' WHEN 1 THEN 'PART_OF' WHEN 2 THEN 'WORKS_AT' ELSE 'RELATED_TO' END AS rel, p_brand AS dst_id FROM part")
def triple_edges(spark, sf_dir):
    said = F.element_at(F.array(*map(F.lit, ("met with", "part of", "works in", "glows"))), F.col("p_size") % 4 + 1)
    return writers.triple_edges(D.table(spark, sf_dir, "part").select(F.col("p_name").alias("subject"), said.alias("predicate"), F.col("p_brand").alias("object"))).select("src_id", "rel", "dst_id")


@query("SELECT doc_id, 'files:v2:' || doc_id AS source_id FROM documents")
def legacy_ids(spark, sf_dir):
    """Half of the ids have the new prefix already."""
    rows = D.table(spark, sf_dir, "documents").selectExpr("doc_id", "concat(IF(doc_id % 2 = 0, 'files:', 'files:v2:'), doc_id) AS source_id")
    return writers.rewrite_ids(rows, "source_id", "files:", "files:v2:")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100")
def kept_newest(spark, sf_dir):
    return writers.keep_newest(D.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.desc(F.struct("o_orderdate", "o_orderkey")))


# --- queue


@query("SELECT event_id AS id, 'user:' || user_id AS source_id FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 20")
def queue_claim(spark, sf_dir):
    return Q.claim(D.queue(spark, sf_dir), 20).select("id", "source_id")


STATUS = "CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN '{view}' WHEN 'error' THEN '{error}' ELSE 'done' END"


@query(f"SELECT event_id AS id, {STATUS.format(view='pending', error='failed')} AS status FROM events")
def queue_recover(spark, sf_dir):
    return Q.recover(D.queue(spark, sf_dir)).select("id", "status")


@query(f"SELECT event_id AS id, {STATUS.format(view='processing', error='pending')} AS status, CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 4 END::INT AS attempts FROM events")
def queue_failed_again(spark, sf_dir):
    return Q.retry(D.queue(spark, sf_dir)).select("id", "status", "attempts")


@query("SELECT event_id AS id FROM events WHERE event_type <> 'error'")
def queue_purge(spark, sf_dir):
    return Q.purge(D.queue(spark, sf_dir), "failed").select("id")


@query("SELECT round(avg(value) * 12, 6) AS eta FROM (SELECT value FROM events ORDER BY ts DESC LIMIT 50)")
def queue_eta(spark, sf_dir):
    return Q.eta_seconds(D.table(spark, sf_dir, "events").selectExpr("ts AS finished_at", "value AS seconds"), F.lit(12)).select(F.round("eta", 6).alias("eta"))


@query("SELECT event_id AS id, props AS error FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 50")
def failure_list(spark, sf_dir):
    return Q.failures(D.table(spark, sf_dir, "events").selectExpr("event_id AS id", "event_type AS source_type", "props AS error"), "error").select("id", "error")


@query("SELECT event_type, sum(event_id % 3)::BIGINT AS n FROM events GROUP BY 1 HAVING sum(event_id % 3) > 0")
def named_counters(spark, sf_dir):
    """Counters that are not zero, by name."""
    return Q.counters(D.table(spark, sf_dir, "events").selectExpr("event_type", "event_id % 3 AS n"), "event_type")


# --- identity


@query("""WITH RECURSIVE k AS (SELECT c_custkey AS n, 'cust:' || lpad(c_custkey::VARCHAR, 8, '0') AS id, c_custkey % 400 AS key FROM customer),
e AS (SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.key = y.key AND x.n <> y.n WHERE NOT (least(x.n, y.n) % 3 = 0 AND abs(x.n - y.n) = 400)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a) SELECT a AS id, least(a, min(b)) AS component FROM r GROUP BY a""")
def same_as_blocked(spark, sf_dir):
    """Persons of one address are one, but for pairs that are blocked: whoever an unblocked pair still ties stays tied."""
    persons = D.persons(spark, sf_dir)
    never = persons.where("c_custkey % 3 = 0").selectExpr("source_id AS a", "concat('cust:', lpad(c_custkey + 400, 8, '0')) AS b")
    return graph.components(identity.by_email(persons, never), "src_id", "dst_id")


@query("""WITH k AS (SELECT 'cust:' || lpad(c_custkey::VARCHAR, 8, '0') AS id, 'T' || (c_custkey % 2) || '/U' || (c_custkey % 300) AS key FROM customer WHERE c_custkey % 7 <> 0)
SELECT f.a AS src_id, k.id AS dst_id, 'slack_user_id' AS match_type FROM k JOIN (SELECT key, min(id) AS a FROM k GROUP BY key) f ON k.key = f.key WHERE k.id <> f.a""")
def same_as_chat_id(spark, sf_dir):
    persons = D.persons(spark, sf_dir).selectExpr("source_id", "concat('T', c_custkey % 2) AS team_id", "IF(c_custkey % 7 = 0, null, concat('U', c_custkey % 300)) AS slack_user_id")
    return identity.by_chat_id(persons).select("src_id", "dst_id", "match_type")


@query("""WITH k AS (SELECT 'cust:' || lpad(c_custkey::VARCHAR, 8, '0') AS id FROM customer WHERE c_custkey % 400 IN (3, 11) UNION ALL SELECT 'person:nobody@example.org')
SELECT (SELECT min(id) FROM k) AS src_id, id AS dst_id, 'self_identity' AS match_type FROM k WHERE id <> (SELECT min(id) FROM k)""")
def self_edges(spark, sf_dir):
    return identity.self_identity(D.persons(spark, sf_dir), ["U3+work@googlemail.com", " u11@gmail.com", "Nobody@example.org"])[1].select("src_id", "dst_id", "match_type")


# --- predicates


@query("SELECT event_id FROM events WHERE event_id % 3 = 0 OR ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-10'")
def date_window(spark, sf_dir):
    day = "date_format(ts, 'yyyy-MM-dd')"
    value = F.expr(f"CASE event_id % 3 WHEN 0 THEN IF(event_id % 2 = 0, '', 'someday') WHEN 1 THEN concat({day}, 'T23:59:59Z') ELSE {day} END")
    return D.table(spark, sf_dir, "events").where(filters.in_dates(value, datetime.date(2024, 1, 5), datetime.date(2024, 1, 10))).select("event_id")


@query("SELECT p_partkey FROM part WHERE contains(lower('/Notes/' || p_brand || '/' || p_name), '/brand#1') OR contains(lower('/Notes/' || p_brand || '/' || p_name), 'brand#23/')")
def folder_filter(spark, sf_dir):
    return D.table(spark, sf_dir, "part").where(filters.in_folders(F.expr("concat('/Notes/', p_brand, '/', p_name)"), ["/BRAND#1", "Brand#23/"])).select("p_partkey")


@query("SELECT DISTINCT sha256(p_name || (p_partkey % 500)) AS sha256 FROM part WHERE p_size * 2000 BETWEEN 10000 AND 60000 AND NOT (p_partkey % 10 = 4) EXCEPT SELECT sha256(p_name || (p_partkey % 500)) FROM part WHERE p_size = 11")
def image_queue(spark, sf_dir):
    shape = "sha2(concat(p_name, p_partkey % 500), 256) AS sha256"
    part = D.table(spark, sf_dir, "part")
    images = part.selectExpr("concat('/i/', IF(p_partkey % 10 = 4, 'thumb_', ''), p_partkey, '.png') AS path", "p_size * 2000 AS size", shape)
    return filters.image_queue(images, part.where("p_size = 11").selectExpr(shape), 10_000, 60_000, "^thumb_").select("sha256")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def read_only_statement(spark, sf_dir):
    D.table(spark, sf_dir, "orders").createOrReplaceTempView("kgloom_orders")
    return filters.read_only(spark, "SELECT o_orderstatus, count(*) AS n FROM kgloom_orders GROUP BY o_orderstatus;")


# --- scalar functions


@query(r"SELECT c_custkey, mail, regexp_matches(mail, '^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$') AND length(mail) <= 254 AS valid FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'a.b+' || c_custkey || '@mail.example.org' WHEN 1 THEN c_name || '@x.org' ELSE repeat('a', 240 + (c_custkey % 20)::INT) || '@x.org' END AS mail FROM customer)")
def valid_addresses(spark, sf_dir):
    rows = D.table(spark, sf_dir, "customer").selectExpr("c_custkey", "CASE c_custkey % 3 WHEN 0 THEN concat('a.b+', c_custkey, '@mail.example.org') WHEN 1 THEN concat(c_name, '@x.org') ELSE concat(repeat('a', cast(240 + c_custkey % 20 AS int)), '@x.org') END AS mail")
    return rows.withColumn("valid", T.valid_email(F.col("mail")))


#: Endings of paths and what they are, every row of the table in turn, then some that are none of it.
ENDINGS = [(f".{e}", e, m) for e, m in T.EXTENSION_MIMES.items()] + [(".PDF", "pdf", "application/pdf"), (".tar.gz", "gz", "application/octet-stream"), ("", "", "application/octet-stream"), ("/.md", "md", "application/octet-stream"), (".Yml", "yml", "text/yaml")]
_CASE = lambda k: " ".join(f"WHEN {n} THEN '{e[k]}'" for n, e in enumerate(ENDINGS))


@query(f"""SELECT p_partkey, CASE WHEN p_partkey % {len(ENDINGS)} = {[e[0] for e in ENDINGS].index("/.md")} THEN '.md' ELSE p_partkey || CASE p_partkey % {len(ENDINGS)} {_CASE(0)} END END AS name,
CASE p_partkey % {len(ENDINGS)} {_CASE(1)} END AS extension, CASE p_partkey % {len(ENDINGS)} {_CASE(2)} END AS mime,
CASE p_partkey % {len(ENDINGS)} {" ".join(f"WHEN {n} THEN '{T.MIME_LABELS.get(e[2], e[2].split('/')[1].upper())}'" for n, e in enumerate(ENDINGS))} END AS label FROM part""")
def path_types(spark, sf_dir):
    """Name, extension, type and label of paths with every known ending."""
    path = F.concat(F.lit("/h/a.b/"), F.col("p_partkey"), F.element_at(F.array(*(F.lit(e[0]) for e in ENDINGS)), (F.col("p_partkey") % len(ENDINGS) + 1).cast("int")))
    mime = T.mime_of_path(path)
    return D.table(spark, sf_dir, "part").select("p_partkey", T.base_name(path).alias("name"), T.extension(path).alias("extension"), mime.alias("mime"), T.mime_label(mime).alias("label"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'https://mail.google.com/mail/u/0/#all/' || event_id WHEN 1 THEN 'omnifocus://' || event_id WHEN 2 THEN 'file:///h/' || event_id || '.md'
WHEN 3 THEN 'https://www.google.com/calendar/event?eid=' || rtrim(to_base64(encode(event_id || ' me@x.org/primary')), '=') END AS url FROM events""")
def clickable_ids(spark, sf_dir):
    source_id = F.expr("CASE event_id % 5 WHEN 0 THEN concat('gmail://me@x.org/message/', event_id) WHEN 1 THEN concat('omnifocus://', event_id) WHEN 2 THEN concat('/h/', event_id, '.md') WHEN 3 THEN concat('google-calendar://me@x.org/event/', event_id) ELSE concat('slack:', event_id) END")
    return D.table(spark, sf_dir, "events").select("event_id", T.clickable(source_id).alias("url"))


@query("SELECT event_id, 'https://mail.google.com/mail/?ui=2&view=cv&th=' || user_id AS mail, 'https://' || event_type || '.slack.com/archives/C' || user_id || '/p1715800000' || lpad((event_id % 1000000)::VARCHAR, 6, '0') AS chat FROM events")
def parent_links(spark, sf_dir):
    stamp = F.expr("concat('1715800000.', lpad(event_id % 1000000, 6, '0'))")
    chat = T.parent_url("slack", team_domain=F.col("event_type"), channel_id=F.expr("concat('C', user_id)"), ts=stamp)
    return D.table(spark, sf_dir, "events").select("event_id", T.parent_url("gmail", thread_id=F.col("user_id").cast("string")).alias("mail"), chat.alias("chat"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '([a-zA-Z][a-zA-Z0-9+.-]*://)[^/\s@]+@', '\1***@', 'g'), '(?i)((?:password|passwd|secret|token|api_?key)\s*[:=]\s*)\S+', '\1<REDACTED>', 'g') AS text FROM documents")
def hidden_credentials(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", T.without_credentials(F.col("text")).alias("text"))


@query(r"SELECT doc_id, CASE WHEN length(text) <= 200 THEN text WHEN regexp_extract(substr(text, 1, 200), '(?s)^(.*)\s\S*$', 1) <> '' THEN regexp_extract(substr(text, 1, 200), '(?s)^(.*)\s\S*$', 1) ELSE substr(text, 1, 200) END AS head FROM documents")
def cut_texts(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", T.cut_at_word(F.col("text"), 200).alias("head"))


@query("""SELECT p_partkey, rtrim(substr(trim(p_name), 1, 9)) AS head, (p_size)::VARCHAR AS major, '~/' || p_name AS path, CASE WHEN p_size % 2 = 0 THEN 'omnifocus://' || p_partkey ELSE 'gmail://task/' || p_partkey END AS url, '1715800000.' || lpad(p_size::VARCHAR, 6, '0') AS at FROM part""")
def string_rules(spark, sf_dir):
    url = F.expr("IF(p_size % 2 = 0, concat('omnifocus://task/', p_partkey), concat('gmail://task/', p_partkey))")
    return D.table(spark, sf_dir, "part").select(
        "p_partkey",
        T.capped(F.col("p_name"), 9).alias("head"),
        T.major_version(F.expr("concat(p_size, '.4.1')")).alias("major"),
        T.without_home(F.expr("concat('/home/me/', p_name)"), "/home/me").alias("path"),
        T.task_url(url).alias("url"),
        T.dotted_ts(F.expr("concat('1715800000', lpad(p_size, 6, '0'))")).alias("at"),
    )


@query("SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN '{\"a\": ' || event_id || '}' END AS found FROM events")
def json_of_answers(spark, sf_dir):
    said = F.expr("IF(event_id % 3 = 0, concat('none { ', event_id), concat('<think>{\"no\": 1}</think> Sure:\\n{\"a\": ', event_id, '} done'))")
    return D.table(spark, sf_dir, "events").select("event_id", T.lenient_json(said).alias("found"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'a b ' || p_partkey WHEN 1 THEN '`# ' || p_partkey || '`' WHEN 2 THEN repeat('x', 199) || '…' ELSE '`x' || p_partkey || '`' END AS name FROM part")
def inline_names(spark, sf_dir):
    raw = F.expr(r"CASE p_size % 4 WHEN 0 THEN concat('  a\t\n b ', p_partkey) WHEN 1 THEN concat('# ', p_partkey) WHEN 2 THEN repeat('x', 201) ELSE concat('`x', p_partkey, '`') END")
    return D.table(spark, sf_dir, "part").select("p_partkey", T.inline_name(raw).alias("name"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d') WHEN 2 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS taken FROM events")
def camera_dates(spark, sf_dir):
    raw = F.expr("CASE event_id % 4 WHEN 0 THEN date_format(ts, 'yyyy:MM:dd HH:mm:ss') WHEN 1 THEN date_format(ts, 'yyyy/MM/dd') WHEN 2 THEN '0000:00:00 00:00:00' ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\") END")
    return D.table(spark, sf_dir, "events").select("event_id", times.exif_date(raw).alias("taken"))


@query("""SELECT c_custkey, CASE WHEN v <> 0 AND abs(v) <= CASE WHEN ref IN ('N', 'S') THEN 90 ELSE 180 END THEN round(v, 9) END AS degrees FROM (SELECT c_custkey, ref, (c_custkey % 200 + c_nationkey / 60.0::DOUBLE + 30 / 3600.0::DOUBLE) * CASE WHEN ref IN ('S', 'W') THEN -1 ELSE 1 END AS v
FROM (SELECT *, ['N', 'S', 'E', 'W'][c_custkey % 4 + 1] AS ref FROM customer))""")
def camera_positions(spark, sf_dir):
    ref = F.expr("element_at(array('N', 'S', 'E', 'W'), cast(c_custkey % 4 + 1 AS int))")
    value = times.decimal_degrees(F.col("c_custkey") % 200, F.col("c_nationkey"), F.lit(30.0), ref)
    return D.table(spark, sf_dir, "customer").select("c_custkey", F.round(value, 9).alias("degrees"))


NOW = datetime.datetime(2031, 5, 14, 15, 30, tzinfo=datetime.timezone.utc)


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN now - to_hours(event_id % 50) WHEN 1 THEN now - to_days((event_id % 9)::INT) WHEN 2 THEN now - to_days((7 * (event_id % 5))::INT) WHEN 3 THEN now - to_days((30 * (event_id % 4))::INT)
WHEN 4 THEN date_trunc('day', now) - to_days(1) WHEN 5 THEN now - to_days(7) WHEN 6 THEN now ELSE TIMESTAMP '2031-01-01' + to_days((event_id % 28)::INT) END AS moment FROM events, (SELECT TIMESTAMP '2031-05-14 15:30:00' AS now)""")
def relative_times(spark, sf_dir):
    """What each event's phrase means; every phrase is read once, whatever the number of events."""
    said = F.expr("""CASE event_id % 8 WHEN 0 THEN concat(event_id % 50, 'h') WHEN 1 THEN concat(event_id % 9, ' days') WHEN 2 THEN concat(event_id % 5, 'w') WHEN 3 THEN concat(event_id % 4, 'm')
WHEN 4 THEN 'yesterday' WHEN 5 THEN 'last week' WHEN 6 THEN 'now' ELSE concat('2031-01-', lpad(event_id % 28 + 1, 2, '0')) END""")
    rows = D.table(spark, sf_dir, "events").select("event_id", said.alias("said"))
    return rows.select("event_id", times.relative_times(F.col("said"), NOW).alias("moment"))


@query("""SELECT conv_id, turn, CASE turn % 7 WHEN 0 THEN DATE '2031-05-14' WHEN 1 THEN DATE '2031-05-13' WHEN 2 THEN DATE '2031-05-12' WHEN 3 THEN DATE '2031-05-01' WHEN 4 THEN DATE '2031-05-14' - (conv_id % 30 + 1)::INT + 1 WHEN 5 THEN DATE '2031-05-08' END AS first,
CASE turn % 7 WHEN 1 THEN DATE '2031-05-13' WHEN 6 THEN NULL ELSE DATE '2031-05-14' END AS last FROM conversations WHERE turn IS NOT NULL""")
def question_windows(spark, sf_dir):
    """The days that each turn's question is about."""
    asked = F.expr("""CASE turn % 7 WHEN 0 THEN concat('What came in today', chr(8212), 'and from whom, ', role, '?') WHEN 1 THEN 'Who wrote yesterday\\'s mails?' WHEN 2 THEN '(this week)' WHEN 3 THEN 'bills of this month\u2026'
WHEN 4 THEN concat('mails of the last ', conv_id % 30 + 1, ' days') WHEN 5 THEN 'what was \u201clast week\u201d' ELSE concat('anything new, ', role, ', in last-week order?') END""")
    found = times.question_windows(asked, NOW.date())
    return D.table(spark, sf_dir, "conversations").where("turn IS NOT NULL").select("conv_id", "turn", found["first"].alias("first"), found["last"].alias("last"))


@query(r"SELECT conv_id, turn, contains(id, '/') OR length(id) > 20 OR starts_with(id, 'msg-') OR starts_with(id, 'file-') OR starts_with(id, 'source-') AS cited FROM (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'msg-' || conv_id WHEN 1 THEN role || '/' || conv_id ELSE substr(text, 1, (conv_id % 40)::INT) END AS id FROM conversations)")
def citations(spark, sf_dir):
    said = F.expr("CASE turn % 3 WHEN 0 THEN concat('msg-', conv_id) WHEN 1 THEN concat(role, '/', conv_id) ELSE substring(text, 1, cast(conv_id % 40 AS int)) END")
    return D.table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.is_citation(said).alias("cited"))


@query("""SELECT event_id, '{' || chr(10) || '  "k": ' || event_id || chr(10) || '}' AS body FROM events""")
def unfenced_answers(spark, sf_dir):
    body = "concat('{\\n  \"k\": ', event_id, '\\n}')"
    return D.table(spark, sf_dir, "events").select("event_id", answers.unfenced(F.expr(f"IF(event_id % 2 = 0, concat('```json\\n', {body}, '\\n```\\n'), {body})")).alias("body"))


@query("SELECT p_partkey, p_brand_words AS q FROM (SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(p_brand || ' a:b ' || p_brand, '\\s+'), lambda w: w <> ''), lambda w: replace(w, ':', '\\:') || '~'))), ' ') AS p_brand_words FROM part)")
def fuzzy_queries(spark, sf_dir):
    return D.table(spark, sf_dir, "part").select("p_partkey", answers.fuzzy_query(F.array(F.concat("p_brand", F.lit(" a:b")), "p_brand")).alias("q"))


# --- sources


@query("""SELECT 'Email' AS label, p AS property, count(*) AS n FROM (SELECT unnest(['date', 'subject']) AS p FROM orders) GROUP BY p UNION ALL SELECT 'File', p, count(*) FROM (SELECT unnest(['title', 'updated']) AS p FROM documents) GROUP BY p""")
def schema_properties(spark, sf_dir):
    return graph.schema_summary(_mails(spark, sf_dir).unionByName(_files(spark, sf_dir)[0]), D.edges(spark, sf_dir))[0]


@query("SELECT coalesce(c.name, s.name) AS name, CASE WHEN s.name IS NULL THEN 'created' WHEN c.name IS NULL THEN 'deleted' ELSE 'modified' END AS operation FROM (SELECT p_partkey::VARCHAR AS name, p_size AS v FROM part WHERE p_partkey % 7 <> 0) c FULL JOIN (SELECT p_partkey::VARCHAR AS name, CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE p_size END AS v FROM part WHERE p_partkey % 5 <> 0) s ON c.name = s.name WHERE c.name IS NULL OR s.name IS NULL OR c.v <> s.v")
def package_changes(spark, sf_dir):
    part = D.table(spark, sf_dir, "part")
    now = part.where("p_partkey % 7 <> 0").selectExpr("cast(p_partkey AS string) AS name", "cast(p_size AS string) AS version")
    then = part.where("p_partkey % 5 <> 0").selectExpr("cast(p_partkey AS string) AS name", "cast(IF(p_partkey % 4 = 0, 0, p_size) AS string) AS version")
    return snapshots.version_changes(now, then)


@query("SELECT 'todo:' || p_partkey AS source_id, 'modified' AS operation FROM part WHERE p_partkey % 6 = 0")
def task_changes(spark, sf_dir):
    """Tags in another order are no change; another status is one."""
    part = D.table(spark, sf_dir, "part")
    now = part.selectExpr("concat('todo:', p_partkey) AS source_id", "p_name AS name", "IF(p_partkey % 6 = 0, 'done', 'open') AS status", "array(p_brand, 'x') AS tags")
    then = part.selectExpr("concat('todo:', p_partkey) AS source_id", "p_name AS name", "'open' AS status", "array('x', p_brand) AS tags")
    return snapshots.task_changes(now, then, ("name", "status"))


@query("SELECT event_id, CASE WHEN user_id % 5 = 0 OR r = 1 THEN props ELSE '' END AS text FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) AS r FROM events)")
def series_text(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").selectExpr("event_id", "IF(user_id % 5 = 0, null, user_id) AS series_id", "ts AS start_time", "cast(event_id AS string) AS source_id", "props AS text")
    return snapshots.series_text_once(rows).select("event_id", "text")


@query("""SELECT 'person:u' || user_id || '@gmail.com' AS src_id, 'AUTHORED' AS rel, 'c' || event_id AS dst_id FROM events UNION ALL SELECT 'c' || event_id, 'PART_OF', 'r' || (user_id % 5) FROM events
UNION ALL SELECT 'c' || event_id, 'MODIFIED', 'r' || (user_id % 5) || '/' || f FROM (SELECT *, unnest(['a.py', event_type]) AS f FROM events)""")
def commit_edges(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").selectExpr("concat('c', event_id) AS source_id", "concat(' U', user_id, '+x@GoogleMail.com') AS author_email", "concat('r', user_id % 5) AS repository", "array('a.py', event_type) AS changed_files")
    return parsers.commits(rows).select("src_id", "rel", "dst_id")


@query("""SELECT 'app:' || p_partkey AS src_id, 'CATEGORIZED_AS' AS rel, p_type AS dst_id FROM part UNION ALL SELECT 'app:' || p_partkey, 'PROVIDES', b FROM (SELECT p_partkey, unnest([p_brand, 'x' || p_size]) AS b FROM part)
UNION ALL SELECT 'app:' || p_partkey, 'INSTALLED_VIA', 'brew' FROM part WHERE p_size % 2 = 0""")
def application_edges(spark, sf_dir):
    rows = D.table(spark, sf_dir, "part").selectExpr("concat('app:', p_partkey) AS source_id", "p_type AS category", "array(p_brand, concat('x', p_size)) AS binaries", "IF(p_size % 2 = 0, 'brew', null) AS installed_via")
    return parsers.applications(rows).select("src_id", "rel", "dst_id")


@query("""SELECT 'todo:' || p_partkey AS src_id, 'TAGGED' AS rel, t AS dst_id FROM (SELECT p_partkey, unnest([p_brand, 'People/Jo']) AS t FROM part) UNION ALL SELECT 'todo:' || p_partkey, 'IN_PROJECT', 'proj:' || p_size FROM part
UNION ALL SELECT 'todo:' || p_partkey, 'SUBTASK_OF', 'todo:' || (p_partkey - 1) FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'todo:' || p_partkey, 'MENTIONS', 'name:Mia' FROM part
UNION ALL SELECT 'todo:' || p_partkey, 'MENTIONS', 'name:Jo' FROM part UNION ALL SELECT 'todo:' || p_partkey, 'MENTIONS', 'person:u' || p_size || '@x.org' FROM part""")
def task_edges(spark, sf_dir):
    rows = D.table(spark, sf_dir, "part").selectExpr(
        "concat('todo:', p_partkey) AS source_id", "'Call @Mia' AS name", "concat('write to u', p_size, '@x.org') AS note", "array(p_brand, 'People/Jo') AS tags", "concat('proj:', p_size) AS project", "IF(p_partkey % 2 = 0, concat('todo:', p_partkey - 1), null) AS parent"
    )
    return parsers.tasks(rows).select("src_id", "rel", "dst_id")


# --- vectors


def _unit_vectors(spark, sf_dir):
    return neighbours.packed(neighbours.clean(D.vectors(spark, sf_dir), "vec_id"), cosine=True)


@query()
def knn_graph(spark, sf_dir):
    """About the 15 nearest of every vector; the tests measure its recall against the exact graph."""
    return neighbours.knn_graph(_unit_vectors(spark, sf_dir)).select("id", "hit", F.round("distance", 6).alias("distance"))


@query()
def density_topics(spark, sf_dir):
    """Density clusters of all vectors, noise -1; the tests hold them against the definition."""
    return density.density_clusters(D.vectors(spark, sf_dir).selectExpr("vec_id AS id", "vector"))


@query("""WITH v AS (SELECT vec_id AS id, list_transform(e, lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings))
SELECT id, hit, round(d, 6) AS distance FROM (SELECT q.id, v.id AS hit, list_distance(q.e, v.e) AS d, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.e, v.e), v.id) AS r FROM v q JOIN v ON q.id <> v.id WHERE q.id % 20 = 0) WHERE r <= 10""")
def index_all_lists(spark, sf_dir):
    """The nearest of every twentieth vector in an index of all, with all its lists probed: the exact result."""
    vectors = D.vectors(spark, sf_dir).selectExpr("vec_id AS id", "vector")
    index = vector_index.build(vectors)
    return index.search(vectors.where("id % 20 = 0"), 10, max(1, index.lists)).select("id", "hit", F.round("distance", 6).alias("distance"))


@query()
def index_probed(spark, sf_dir):
    """As ``index_all_lists`` with as many lists as a sample of the queries needs; the tests measure its recall."""
    vectors = D.vectors(spark, sf_dir).selectExpr("vec_id AS id", "vector")
    index, asked = vector_index.build(vectors), vectors.where("id % 20 = 0")
    return index.search(asked, 10, index.probes_for(asked)).select("id", "hit", F.round("distance", 6).alias("distance"))


# --- tables kept batch by batch


def _kept(spark, make):
    """The result of ``make(folder)`` as a table; the folder of the store goes."""
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    try:
        return written(make(folder), "kept")
    finally:
        remove(spark, folder)


@query("""SELECT o_orderkey::VARCHAR AS order_id, coalesce(r.status, o_orderstatus) AS status, coalesce(r.lines, 0) AS lines
FROM orders LEFT JOIN (SELECT l_orderkey, 'R' AS status, count(*) AS lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) r ON l_orderkey = o_orderkey""")
def bucketed_upsert(spark, sf_dir):
    """All orders in buckets; then those with returned lines replace their rows."""

    def make(folder):
        store = buckets.BucketStore(spark, folder, {"orders": "order_id string, status string, lines long"}, {"orders": "order_id"}, 16)
        store.write(orders=D.table(spark, sf_dir, "orders").selectExpr("cast(o_orderkey AS string) AS order_id", "o_orderstatus AS status", "0L AS lines"))
        returned = D.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count("*").alias("lines"))
        store.upsert("orders", returned.selectExpr("cast(l_orderkey AS string) AS order_id", "'R' AS status", "lines"), ["order_id"])
        return store.read("orders")

    return _kept(spark, make)


@query("""SELECT 'doc:' || doc_id AS source_id, sha256(CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || ' again' ELSE coalesce(text, '') END) AS content_hash, TIMESTAMP '2026-01-02' AS indexed_at FROM documents WHERE doc_id % 3 <> 1""")
def ingested_documents(spark, sf_dir):
    """Documents after two batches: created all, then a third of them changed, a third deleted, a third sent again as they were."""

    def make(folder):
        store = buckets.graph_store(spark, folder, 16)
        docs = D.table(spark, sf_dir, "documents").selectExpr("concat('doc:', doc_id) AS source_id", "'files' AS source_type", "doc_id % 3 AS turn", "coalesce(text, '') AS text")
        buckets.apply_batch(store, docs.selectExpr("source_id", "source_type", "'created' AS operation", "text", "timestamp'2026-01-01' AS enqueued_at"))
        buckets.apply_batch(store, docs.selectExpr("source_id", "source_type", "IF(turn = 1, 'deleted', 'modified') AS operation", "IF(turn = 0, concat(text, ' again'), text) AS text", "timestamp'2026-01-02' AS enqueued_at"))
        return store.read("nodes").selectExpr("source_id", "content_hash", "cast(indexed_at AS timestamp_ntz) AS indexed_at")

    return _kept(spark, make)


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 5 <> 4 UNION ALL SELECT c_custkey, c_custkey + 10 FROM customer WHERE c_custkey % 50 = 0 AND c_custkey % 100 <> 0),
ids AS (SELECT a AS id FROM e UNION SELECT b FROM e UNION SELECT c_custkey + 10 FROM customer WHERE c_custkey % 50 = 0),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT id, id FROM ids UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT lpad(a::VARCHAR, 10, '0') AS id, lpad(min(b)::VARCHAR, 10, '0') AS component FROM r GROUP BY a""")
def kept_labels(spark, sf_dir):
    """Labels of the customers' chains after a batch that ties some of them and one that unties a half of these again."""
    key = lambda rows: rows.selectExpr("lpad(cast(a AS string), 10, '0') AS a", "lpad(cast(b AS string), 10, '0') AS b")
    ties = D.table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").selectExpr("c_custkey AS a", "c_custkey + 10 AS b")

    def make(folder):
        kept = labels.Labels(spark, folder, 16)
        kept.add(key(D.table(spark, sf_dir, "customer").where("c_custkey % 5 <> 4").selectExpr("c_custkey AS a", "c_custkey + 1 AS b")))
        kept.add(key(ties))
        kept.remove(key(ties.where("a % 100 = 0")), block=True)
        return kept.table()

    return _kept(spark, make)
