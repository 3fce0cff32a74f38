"""Queries over the driver's tables, one for each operator or composition, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import driver_views as D
from .functions import answers, chunking, fuzzy, text as T, times, vectors as V
from .operators import clustering, filters, graph, identity, queue as Q, writers
from .plans import activity, people, search
from .sources import parsers, snapshots
from .streaming import chats, sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is one."""

    def keep(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def ts(value: str):
    return F.lit(value).cast("timestamp_ntz")


FILES = "SELECT 'doc:' || doc_id AS source_id, 'Doc ' || doc_id AS title, TIMESTAMP '1995-01-01' + to_hours(doc_id) AS created, TIMESTAMP '1995-01-01' + to_hours(doc_id) + to_days((doc_id % 3)::INT) AS updated FROM documents"
TASKS = "SELECT 'task:' || l_orderkey || ':' || l_linenumber AS source_id, 'Line ' || l_linenumber || ' of ' || l_orderkey AS name, CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'active' END AS status, l_shipdate - to_days(CASE WHEN l_linenumber = 1 THEN 0 ELSE 3 END) AS cr, l_shipdate AS mo, CASE WHEN l_linestatus = 'F' THEN l_shipdate + to_days(1) END AS co FROM lineitem"
WINDOW = "BETWEEN TIMESTAMP '1995-01-10' AND TIMESTAMP '1995-02-20'"
TIMELINE = f"""
WITH files AS ({FILES}), tasks AS ({TASKS}),
rows AS (
  SELECT source_id, 'File' AS label, title, updated AS ts, CASE WHEN created = updated THEN 'created' ELSE 'modified' END AS event_type FROM files WHERE (updated {WINDOW} OR created {WINDOW}) AND updated {WINDOW}
  UNION ALL SELECT * FROM (SELECT source_id, 'Task' AS label, name AS title, coalesce(CASE WHEN co {WINDOW} THEN co END, CASE WHEN mo {WINDOW} THEN mo END, cr) AS ts,
    CASE WHEN status = 'completed' THEN 'completed' WHEN cr = mo THEN 'created' ELSE 'modified' END AS event_type FROM tasks WHERE mo {WINDOW} OR co {WINDOW} OR cr {WINDOW}) WHERE ts {WINDOW}
  UNION ALL SELECT 'mail:' || o_orderkey, 'Email', 'Order ' || o_orderkey, o_orderdate, 'created' FROM orders WHERE o_orderdate {WINDOW}
  UNION ALL SELECT 'event:' || event_id, 'Commit', event_type, ts, 'created' FROM events WHERE ts {WINDOW}
  UNION ALL SELECT 'part:' || p_partkey, 'Application', p_name, TIMESTAMP '1996-01-01' + to_hours(p_partkey), 'modified' FROM part WHERE TIMESTAMP '1996-01-01' + to_hours(p_partkey) {WINDOW})
"""
SINCE, UNTIL = "1995-01-10", "1995-02-20"


# --- timeline and digest


@query(TIMELINE + "SELECT source_id, label, title, ts, event_type FROM rows ORDER BY ts DESC, label, source_id LIMIT 500")
def timeline_all(spark, sf_dir):
    return activity.timeline(D.activity(spark, sf_dir), ts(SINCE), ts(UNTIL), limit=500)


@query("SELECT 'event:' || event_id AS source_id, 'Commit' AS label, event_type AS title, ts, 'created' AS event_type FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' ORDER BY ts DESC, source_id LIMIT 50")
def timeline_by_source(spark, sf_dir):
    return activity.timeline(D.activity(spark, sf_dir), ts("2024-01-10"), ts("2024-01-20"), "repositories")


@query(TIMELINE + "SELECT r.source_id, label, title, ts, event_type, coalesce(substr(d.text, 1, 200), '') AS snippet FROM (SELECT * FROM rows WHERE label = 'File' ORDER BY ts DESC, label, source_id LIMIT 50) r LEFT JOIN documents d ON r.source_id = 'doc:' || d.doc_id")
def timeline_snippet(spark, sf_dir):
    chunks = D.table(spark, sf_dir, "documents").selectExpr("concat('doc:', doc_id) AS source_id", "0 AS chunk_index", "text")
    return activity.timeline(D.activity(spark, sf_dir), ts(SINCE), ts(UNTIL), "files", 50, chunks)


@query(TIMELINE + "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT * FROM rows ORDER BY ts DESC, label, source_id LIMIT 500) GROUP BY 1")
def timeline_by_day(spark, sf_dir):
    return activity.by_day(timeline_all(spark, sf_dir))


@query(f"""
WITH files AS ({FILES}), tasks AS ({TASKS}),
ev AS (
  SELECT 'obsidian' AS s, CASE WHEN created = updated THEN 'created' ELSE 'modified' END AS k, title AS t FROM files WHERE updated {WINDOW} OR created {WINDOW}
  UNION ALL SELECT 'omnifocus', CASE WHEN status = 'completed' AND co {WINDOW} THEN 'completed' WHEN cr = mo THEN 'created' ELSE 'modified' END, name FROM tasks WHERE mo {WINDOW} OR co {WINDOW} OR cr {WINDOW}
  UNION ALL SELECT 'gmail', 'created', 'Order ' || o_orderkey FROM orders WHERE o_orderdate {WINDOW}
  UNION ALL SELECT 'repositories', 'created', event_type FROM events WHERE ts {WINDOW}
  UNION ALL SELECT 'apps', 'modified', p_name FROM part WHERE TIMESTAMP '1996-01-01' + to_hours(p_partkey) {WINDOW})
SELECT s AS source_type, count(*) FILTER (k = 'created') AS created, count(*) FILTER (k IN ('modified', 'completed')) AS modified, count(*) FILTER (k = 'completed') AS completed,
  array_to_string(list_sort(list_distinct(list(t)))[1:5], ' | ') AS highlights FROM ev GROUP BY s""")
def digest(spark, sf_dir):
    return activity.digest(D.activity(spark, sf_dir), ts(SINCE), ts(UNTIL))


@query("SELECT count(*) AS new_connections FROM lineitem WHERE l_linenumber <> 1 AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-06-30'")
def new_cross_label_edges(spark, sf_dir):
    rows = D.table(spark, sf_dir, "lineitem").selectExpr("'Email' AS src_label", "IF(l_linenumber = 1, 'Email', 'Application') AS dst_label", "l_shipdate AS created_at")
    return activity.new_connections(rows, ts("1996-01-01"), ts("1996-06-30"))


# --- topics


def _topics(spark, sf_dir):
    part = D.table(spark, sf_dir, "part")
    topics = part.select(F.col("p_brand").alias("name"), F.lit("cluster").alias("source"), F.lit(None).cast("string").alias("description")).distinct()
    user = part.where("p_size < 3").select(F.col("p_brand").alias("name"), F.lit("user").alias("source"), F.lit("mine").alias("description")).where("substr(name, 7, 1) = '1'").distinct()
    tagged = part.select(F.concat(F.lit("part:"), "p_partkey").alias("source_id"), F.col("p_brand").alias("topic"), F.lit("cluster").alias("topic_source"))
    return topics.unionByName(user), tagged


TOPICS = "topics AS (SELECT DISTINCT p_brand AS name, 'cluster' AS source, '' AS description FROM part UNION ALL SELECT DISTINCT p_brand, 'user', 'mine' FROM part WHERE p_size < 3 AND substr(p_brand, 7, 1) = '1')"


@query(f"WITH {TOPICS} SELECT name, source, description, CASE WHEN source = 'cluster' THEN (SELECT count(*) FROM part WHERE p_brand = name) ELSE 0 END AS doc_count FROM topics")
def topic_list(spark, sf_dir):
    return search.list_topics(*_topics(spark, sf_dir))


@query("SELECT 'part:' || p_partkey AS source_id, p_name AS name, 'Application' AS type FROM part WHERE p_brand = 'Brand#12' ORDER BY name, source_id LIMIT 200")
def topic_show(spark, sf_dir):
    docs = D.table(spark, sf_dir, "part").selectExpr("concat('part:', p_partkey) AS source_id", "p_name AS name", "'Application' AS label")
    return search.show_topic("Brand#12", _topics(spark, sf_dir)[1], docs)


@query(f"WITH {TOPICS} SELECT name, description, (SELECT count(*) FROM part WHERE p_brand = name) AS doc_count FROM topics t WHERE source = 'cluster' AND NOT EXISTS (SELECT 1 FROM topics u WHERE u.source = 'user' AND u.name = t.name)")
def topic_gaps(spark, sf_dir):
    return search.topic_gaps(*_topics(spark, sf_dir))


# --- vectors and search

COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / (sqrt(list_sum(list_transform({a}, lambda z: z::DOUBLE * z::DOUBLE))) * sqrt(list_sum(list_transform({b}, lambda z: z::DOUBLE * z::DOUBLE))))"
VEC = "v AS (SELECT 'v' || lpad(vec_id::VARCHAR, 6, '0') AS source_id, 't' || label AS source_type, embedding AS vector, label, vec_id FROM embeddings)"


def _query_vector(spark, sf_dir):
    return V.literal(D.table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"])


@query(f"WITH {VEC} SELECT source_id, round(score, 6) AS score FROM (SELECT v.source_id, {COS.format(a='v.vector', b='q.vector')} AS score FROM v, (SELECT vector FROM v WHERE vec_id = 0) q) ORDER BY score DESC, source_id LIMIT 10")
def vector_topk(spark, sf_dir):
    return search.vector_search(D.vectors(spark, sf_dir), _query_vector(spark, sf_dir)).select("source_id", F.round("score", 6).alias("score"))


@query(f"WITH {VEC} SELECT source_id, round(score, 6) AS score FROM (SELECT v.source_id, {COS.format(a='v.vector', b='q.vector')} AS score FROM v, (SELECT vector FROM v WHERE vec_id = 0) q WHERE source_type = 't3') ORDER BY score DESC, source_id LIMIT 10")
def vector_topk_filtered(spark, sf_dir):
    return search.vector_search(D.vectors(spark, sf_dir), _query_vector(spark, sf_dir), source_type="t3").select("source_id", F.round("score", 6).alias("score"))


@query(f"""WITH {VEC}, g AS (SELECT 'v' || lpad(l_linenumber::VARCHAR, 6, '0') AS source_id, l_linenumber AS pos FROM lineitem WHERE l_orderkey = 7 GROUP BY 1, 2),
h AS (SELECT source_id, row_number() OVER (ORDER BY score DESC, source_id) AS pos FROM (SELECT v.source_id, {COS.format(a='v.vector', b='q.vector')} AS score FROM v, (SELECT vector FROM v WHERE vec_id = 0) q) ORDER BY pos LIMIT 20)
SELECT 0 AS lane, pos::INT AS pos, source_id FROM g UNION ALL SELECT 1, pos::INT, source_id FROM h WHERE source_id NOT IN (SELECT source_id FROM g) AND (contains(source_id, '1') OR contains(source_id, '2')) AND pos % 3 <> 2""")
def hybrid_merge(spark, sf_dir):
    g = D.table(spark, sf_dir, "lineitem").where("l_orderkey = 7").selectExpr("concat('v', lpad(l_linenumber, 6, '0')) AS source_id", "l_linenumber AS pos").distinct()
    hits = search.vector_search(D.vectors(spark, sf_dir), _query_vector(spark, sf_dir), 20)
    ranked = hits.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("score"), "source_id"))).withColumn("date", F.expr("element_at(array('2020-06-01T10:00:00Z', '2021-06-01', ''), cast((pos + 2) % 3 + 1 AS int))"))  # twenty rows
    import datetime

    return search.hybrid_merge(g, ranked, (datetime.date(2020, 1, 1), datetime.date(2020, 12, 31)), ["1", "2"])


@query("""SELECT row_id, score AS rerank_score FROM (SELECT row_id, (list_contains(w, 'the')::INT + list_contains(w, 'que')::INT + list_contains(w, 'und')::INT) / 3.0::DOUBLE AS score
FROM (SELECT conv_id * 1000000 + turn AS row_id, regexp_split_to_array(lower(text), '\\s+') AS w FROM conversations)) WHERE score >= 0.3 ORDER BY score DESC, row_id LIMIT 20""")
def rerank_threshold(spark, sf_dir):
    rows = D.table(spark, sf_dir, "conversations").selectExpr("conv_id * 1000000 + turn AS row_id", "text")
    return V.rerank(rows, "the que und", 20, 0.3, pos_col="row_id").select("row_id", "rerank_score")


@query(f"""WITH {VEC}, s AS (SELECT * FROM v ORDER BY source_id LIMIT 20),
sc AS (SELECT s.source_id AS seed, v.source_id AS hit, {COS.format(a='s.vector', b='v.vector')} AS score FROM s, v WHERE s.source_id <> v.source_id),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY score DESC, hit) AS r FROM sc WHERE score >= 0.2) WHERE r <= 10),
pairs AS (SELECT least(seed, hit) AS a, greatest(seed, hit) AS b, max(score) AS score FROM hits GROUP BY 1, 2),
e AS (SELECT 'v' || lpad(vec_id::VARCHAR, 6, '0') AS a, 'v' || lpad((vec_id + 1)::VARCHAR, 6, '0') AS b FROM embeddings)
SELECT p.a, p.b, round(p.score, 4) AS similarity, x.source_type AS type_a, y.source_type AS type_b FROM pairs p ANTI JOIN e ON p.a = e.a AND p.b = e.b JOIN v x ON x.source_id = p.a JOIN v y ON y.source_id = p.b ORDER BY similarity DESC, p.a, p.b LIMIT 20""")
def connections_suggest(spark, sf_dir):
    v = D.vectors(spark, sf_dir)
    edges = v.selectExpr("source_id AS src_id", "concat('v', lpad(vec_id + 1, 6, '0')) AS dst_id")
    info = v.selectExpr("source_id", "'File' AS label", "source_id AS title", "source_type")
    return search.suggest_connections(v, edges, info, threshold=0.2).select("a", "b", "similarity", "type_a", "type_b")


@query("SELECT label AS cluster, pos::INT AS pos, round(avg(x::DOUBLE), 6) AS value, count(*) AS n FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings WHERE label <> -1) GROUP BY 1, 2")
def cluster_centroids(spark, sf_dir):
    return V.centroids(D.vectors(spark, sf_dir), "label").select("cluster", "pos", F.round("value", 6).alias("value"), "n")


CENTROID = "c AS (SELECT label AS cluster, list(m ORDER BY pos) AS centroid FROM (SELECT label, pos, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(embedding) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY 1)"


@query(f"WITH {CENTROID} SELECT cluster, vec_id, round(d, 6) AS distance, r AS rank FROM (SELECT cluster, vec_id, d, row_number() OVER (PARTITION BY cluster ORDER BY d, vec_id)::INT AS r FROM (SELECT cluster, vec_id, sqrt(list_sum(list_transform(list_zip(embedding, centroid), lambda z: pow(z[1]::DOUBLE - z[2], 2)))) AS d FROM embeddings JOIN c ON label = cluster)) WHERE r <= 20")
def central_members(spark, sf_dir):
    return V.central_members(D.vectors(spark, sf_dir), "label", "vec_id").select("cluster", "vec_id", F.round("distance", 6).alias("distance"), "rank")


@query(f"WITH {CENTROID} SELECT app, cluster, round(score, 6) AS score, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY app ORDER BY score DESC, cluster)::INT AS r FROM (SELECT vec_id AS app, cluster, {COS.format(a='embedding', b='centroid')} AS score FROM embeddings, c) WHERE score >= 0.1) WHERE r <= 3")
def app_topic_link(spark, sf_dir):
    v = D.vectors(spark, sf_dir)
    return clustering.link_apps(v.selectExpr("vec_id AS app", "vector"), V.centroid_arrays(v, "label"), least=0.1).select("app", "cluster", F.round("score", 6).alias("score"), "rank")


@query()
def cluster_embeddings(spark, sf_dir):
    """Learned clusters have no SQL form: checked for separable data in the tests."""
    return clustering.cluster_embeddings(D.vectors(spark, sf_dir).selectExpr("vec_id AS id", "vector"))


# --- graph and people


@query("SELECT 'mail:' || o_orderkey AS other_id FROM orders WHERE o_custkey = 7")
def person_expand(spark, sf_dir):
    return graph.expand(spark.createDataFrame([("cust:7",)], "source_id string"), D.edges(spark, sf_dir), "SENT").select("other_id")


@query("SELECT 'supp:' || l_suppkey AS other_id, count(DISTINCT l_orderkey) AS shared_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = 7 GROUP BY 1 ORDER BY shared_count DESC, other_id LIMIT 5")
def related_people(spark, sf_dir):
    return people.related_people(spark.createDataFrame([("cust:7",)], "source_id string"), D.edges(spark, sf_dir))


@query("SELECT p_brand AS topic_name, count(DISTINCT l_orderkey) AS doc_count FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_custkey = 7 GROUP BY 1 ORDER BY doc_count DESC, topic_name LIMIT 5")
def top_topics(spark, sf_dir):
    return people.top_topics(spark.createDataFrame([("cust:7",)], "source_id string"), D.edges(spark, sf_dir))


@query("SELECT count(*) AS total FROM orders WHERE o_custkey = 7")
def total_interactions(spark, sf_dir):
    return people.total_interactions(spark.createDataFrame([("cust:7",)], "source_id string"), D.edges(spark, sf_dir))


@query("""SELECT component, id AS canonical FROM (SELECT c_nationkey AS component, 'cust:' || c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY coalesce(n, 0) DESC, 'cust:' || c_custkey) AS r
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey) WHERE r = 1""")
def degree_canonical(spark, sf_dir):
    members = D.table(spark, sf_dir, "customer").selectExpr("concat('cust:', c_custkey) AS id", "c_nationkey AS component")
    return graph.canonical(members, D.edges(spark, sf_dir))


@query("""WITH k AS (SELECT 'cust:' || lpad(c_custkey::VARCHAR, 8, '0') AS id, 'u' || (c_custkey % 400) || '@gmail.com' AS key FROM customer)
SELECT f.a AS src_id, k.id AS dst_id, 'email' AS match_type, 1.0::DOUBLE AS confidence FROM k JOIN (SELECT key, min(id) AS a FROM k GROUP BY key) f ON k.key = f.key WHERE k.id <> f.a""")
def same_as_pairs_email(spark, sf_dir):
    return identity.by_email(D.persons(spark, sf_dir)).select("src_id", "dst_id", "match_type", "confidence")


@query("SELECT key, name FROM (SELECT 'u' || (c_custkey % 400) || '@gmail.com' AS key, c_name AS name, row_number() OVER (PARTITION BY c_custkey % 400 ORDER BY length(c_name) DESC, c_custkey) AS r FROM customer) WHERE r = 1")
def longest_name(spark, sf_dir):
    return identity.longest_names(D.persons(spark, sf_dir), T.canonical_email(F.col("email")))


def _chains(spark, sf_dir):
    c = D.table(spark, sf_dir, "customer")
    return c.where("c_custkey % 5 <> 4").selectExpr("c_custkey AS a", "c_custkey + 1 AS b")


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 5 <> 4), u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
walk(a, b, n) AS (SELECT a, b, 1 FROM u UNION SELECT w.a, u.b, w.n + 1 FROM walk w JOIN u ON w.b = u.a WHERE w.n < 4)
SELECT DISTINCT a, b FROM walk WHERE a < b AND (a, b) NOT IN (SELECT a, b FROM e) AND NOT (a % 25 = 0 AND b = a + 3)""")
def same_as_closure(spark, sf_dir):
    never = D.table(spark, sf_dir, "customer").where("c_custkey % 25 = 0").selectExpr("c_custkey + 3 AS a", "c_custkey AS b")
    return graph.closure(_chains(spark, sf_dir), never)


@query("""WITH RECURSIVE e AS (SELECT c_custkey AS a, c_custkey + 1 AS b FROM customer WHERE c_custkey % 5 <> 4 UNION ALL SELECT c_custkey, c_custkey + 10 FROM customer WHERE c_custkey % 50 = 0),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(a, b) AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a)
SELECT a AS id, least(a, min(b)) AS component FROM r GROUP BY a""")
def components(spark, sf_dir):
    more = D.table(spark, sf_dir, "customer").where("c_custkey % 50 = 0").selectExpr("c_custkey AS a", "c_custkey + 10 AS b")
    return graph.components(_chains(spark, sf_dir).unionByName(more))


@query("SELECT l_orderkey FROM lineitem WHERE l_suppkey IN (1, 2) GROUP BY l_orderkey HAVING count(DISTINCT l_suppkey) = 2")
def thread_all_attendees(spark, sf_dir):
    wanted = spark.createDataFrame([(1,), (2,)], "l_suppkey long")
    return graph.relational_division(D.table(spark, sf_dir, "lineitem"), wanted, "l_orderkey", "l_suppkey")


@query("SELECT event_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events l WHERE l.event_type = 'click' AND l.user_id = e.user_id AND l.ts > e.ts)")
def unanswered_mentions(spark, sf_dir):
    events = D.table(spark, sf_dir, "events")
    return graph.unanswered(events.where("event_type = 'error'"), events.where("event_type = 'click'"), "user_id").select("event_id")


@query("SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id HAVING arg_max(role, turn) = 'user'")
def outstanding_threads(spark, sf_dir):
    last = D.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.max_by("role", "turn").alias("role"))
    return last.where("role = 'user'").select("conv_id", "last_turn")


@query("SELECT conv_id, turn, role, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INT AS r FROM conversations) WHERE r <= 3")
def thread_tail(spark, sf_dir):
    return people.last_messages(D.table(spark, sf_dir, "conversations"), "conv_id", F.desc("turn")).select("conv_id", "turn", "role", "rank")


@query("""SELECT o_orderkey, flagged, due, row_number() OVER (ORDER BY flagged DESC, due ASC NULLS LAST, o_orderkey) AS place FROM (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS flagged, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate END AS due FROM orders WHERE o_orderstatus <> 'F') ORDER BY place LIMIT 200""")
def open_tasks_order(spark, sf_dir):
    rows = D.table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderpriority = '1-URGENT' AS flagged", "IF(o_orderkey % 3 <> 0, o_orderdate, null) AS due", "IF(o_orderstatus = 'F', 'completed', null) AS status").where(filters.is_open())
    order = [F.desc("flagged"), F.asc_nulls_last("due"), F.asc("o_orderkey")]
    top = rows.drop("status").orderBy(*order).limit(200)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long"))  # two hundred rows


@query("""WITH p AS (SELECT c_custkey AS id, (c_custkey % 500) * 0.004 AS lat, c_nationkey * 0.003 AS lon FROM customer), q AS (SELECT s_suppkey AS id, (s_suppkey % 500) * 0.004 AS lat, s_nationkey * 0.003 AS lon FROM supplier)
SELECT p.id AS point, q.id AS place FROM p, q WHERE abs(p.lat - q.lat) < 0.005 AND abs(p.lon - q.lon) < 0.005""")
def range_box_join(spark, sf_dir):
    points = D.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "(c_custkey % 500) * 0.004D AS lat", "c_nationkey * 0.003D AS lon")
    places = D.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "(s_suppkey % 500) * 0.004D AS lat", "s_nationkey * 0.003D AS lon")
    return graph.nearby(points, places)


@query("SELECT src_label, rel, dst_label, count(*) AS n FROM (SELECT 'Person' AS src_label, 'SENT' AS rel, 'Email' AS dst_label FROM orders UNION ALL SELECT 'Email', 'MENTIONS', 'Person' FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) UNION ALL SELECT 'Email', 'TAGGED', 'Topic' FROM (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)) GROUP BY ALL")
def schema_patterns(spark, sf_dir):
    nodes = spark.createDataFrame([], "label string, source_id string, source_type string, props map<string,string>")
    return graph.schema_summary(nodes, D.edges(spark, sf_dir))[1]


@query("SELECT rel, count(*) AS n FROM (SELECT 'SENT' AS rel FROM orders UNION ALL SELECT 'MENTIONS' FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) UNION ALL SELECT 'TAGGED' FROM (SELECT DISTINCT l_orderkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey)) GROUP BY rel")
def edge_counts(spark, sf_dir):
    return search.edge_counts(D.edges(spark, sf_dir))


@query("SELECT event_type AS label, count(*) AS n, max(ts) AS last FROM events GROUP BY 1")
def ingest_status(spark, sf_dir):
    return search.ingest_status(D.table(spark, sf_dir, "events").select(F.col("event_type").alias("label"), F.col("ts").alias("modified_at")))


@query("SELECT source AS source_type, count(*) AS n, array_to_string(list_sort(list(doc_id::VARCHAR))[1:3], ',') AS ids FROM documents GROUP BY 1")
def source_groups(spark, sf_dir):
    return search.source_groups(D.table(spark, sf_dir, "documents").select(F.col("source").alias("source_type"), F.col("doc_id").cast("string").alias("source_id")))


@query("SELECT p_partkey, CASE WHEN r > 1 THEN p_name || ' (#' || r || ')' ELSE p_name END AS label FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)")
def numbered_labels(spark, sf_dir):
    return clustering.numbered_labels(D.table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("label")), "p_partkey", "label")


@query()
def fuzzy_name_pairs(spark, sf_dir):
    """No SQL: DuckDB has no such ratio. Tests hold the blocking against all pairs."""
    names = D.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().withColumn("id", F.col("name"))
    return fuzzy.similar_pairs(names, 60.0).select("a", "b", F.round("score", 6).alias("score"))


# --- snapshots, writers, queue


@query("""WITH cur AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 11 = 0 THEN 'x' ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 0), old AS (SELECT o_orderkey AS path, o_orderstatus AS s FROM orders WHERE o_orderkey % 10 <> 0)
SELECT coalesce(cur.path, old.path)::VARCHAR AS path, CASE WHEN old.path IS NULL THEN 'created' WHEN cur.path IS NULL THEN 'deleted' ELSE 'modified' END AS operation FROM cur FULL JOIN old ON cur.path = old.path WHERE old.path IS NULL OR cur.path IS NULL OR cur.s <> old.s""")
def snapshot_diff(spark, sf_dir):
    o = D.table(spark, sf_dir, "orders")
    shape = lambda df, s: df.select(F.col("o_orderkey").cast("string").alias("path"), F.sha2(s, 256).alias("sha256"), F.lit(1).alias("mtime_ns"), "o_orderkey")
    current = shape(o.where("o_orderkey % 7 <> 0"), F.when(F.col("o_orderkey") % 11 == 0, "x").otherwise(F.col("o_orderstatus")))
    return snapshots.file_changes(current, shape(o.where("o_orderkey % 10 <> 0"), F.col("o_orderstatus")))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents d WHERE NOT (doc_id % 4 = 0)")
def content_hash_skip(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents")
    indexed = docs.select("doc_id", T.content_hash(F.expr("IF(doc_id % 4 = 0, text, concat(text, ' then'))")).alias("content_hash"))
    return docs.select("doc_id", T.content_hash(F.col("text")).alias("content_hash")).join(indexed, ["doc_id", "content_hash"], "left_anti")


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT item_id FROM benchmark)")
def already_indexed(spark, sf_dir):
    ids = D.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return D.table(spark, sf_dir, "documents").select("doc_id").join(ids, "doc_id", "left_semi")


@query("""SELECT name, CASE WHEN c > 0.5 THEN type ELSE 'Concept' END AS type, greatest(c, 0.5) AS confidence FROM (SELECT lang || source AS name, arg_max('T' || (doc_id % 7), (doc_id % 10) / 10.0::DOUBLE * 1000000000 - doc_id) AS type, max((doc_id % 10) / 10.0::DOUBLE) AS c FROM documents GROUP BY 1)""")
def upsert_confidence_guard(spark, sf_dir):
    d = D.table(spark, sf_dir, "documents")
    old = d.select(F.concat("lang", "source").alias("name"), F.lit("Concept").alias("type"), F.lit(0.5).alias("confidence")).distinct()
    new = d.select(F.concat("lang", "source").alias("name"), F.concat(F.lit("T"), F.col("doc_id") % 7).alias("type"), ((F.col("doc_id") % 10) / 10.0).alias("confidence"), F.col("doc_id").alias("seq"))
    return writers.upsert_entities(old, new)


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'WORKS_AT' WHEN 1 THEN 'ATTENDED' WHEN 2 THEN 'OWNED_BY' ELSE 'RELATED_TO' END AS rel FROM events")
def predicate_normalise(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ("works at", " Attends", "owns", "zaps"))), (F.col("event_id") % 4 + 1).cast("int"))
    return D.table(spark, sf_dir, "events").select("event_id", writers.predicate(raw).alias("rel"))


@query("SELECT DISTINCT 'mail:' || l_orderkey AS src_id, 'supp:' || l_suppkey AS dst_id FROM lineitem")
def edge_merge(spark, sf_dir):
    lines = D.table(spark, sf_dir, "lineitem")
    shape = lambda df: df.selectExpr("'Email' AS src_label", "concat('mail:', l_orderkey) AS src_id", "'MENTIONS' AS rel", "'Person' AS dst_label", "concat('supp:', l_suppkey) AS dst_id")
    return writers.merge_edges(shape(lines.where("l_linenumber <= 2")).distinct(), shape(lines.where("l_linenumber >= 2"))).select("src_id", "dst_id")


@query("SELECT doc_id::VARCHAR AS name, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphan_entities(spark, sf_dir):
    named = D.table(spark, sf_dir, "documents").selectExpr("cast(doc_id AS string) AS name", "source")
    edges = D.table(spark, sf_dir, "labels").selectExpr("cast(doc_id AS string) AS dst_id")
    return writers.orphans(named, edges, named)


@query("SELECT conv_id || ':chunk:' || turn AS chunk_id FROM conversations WHERE turn >= conv_id % 4")
def stale_chunks(spark, sf_dir):
    c = D.table(spark, sf_dir, "conversations").selectExpr("concat(conv_id, ':chunk:', turn) AS chunk_id", "conv_id AS source_id", "cast(turn AS int) AS chunk_index")
    return writers.stale_chunks(c, c.select("source_id").distinct().withColumn("n", F.col("source_id") % 4)).select("chunk_id")


@query("SELECT event_type AS source_type, CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'done' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def queue_stats(spark, sf_dir):
    return Q.stats(D.queue(spark, sf_dir))


@query("SELECT count(*) AS depth FROM events WHERE event_type IN ('click', 'view')")
def queue_depth(spark, sf_dir):
    return Q.depth(D.queue(spark, sf_dir))


@query("""SELECT event_id AS id, CASE WHEN event_id % 6 = 1 THEN CASE WHEN event_id % 4 + 1 < 3 THEN 'pending' ELSE 'failed' END WHEN event_type = 'click' THEN 'pending' WHEN event_type = 'view' THEN 'processing' WHEN event_type = 'error' THEN 'failed' ELSE 'done' END AS status,
(event_id % 4 + (event_id % 6 = 1)::INT)::INT AS attempts FROM events WHERE event_id % 6 <> 0""")
def queue_retry(spark, sf_dir):
    q = D.queue(spark, sf_dir)
    return Q.finish(q, q.where("id % 6 = 0"), q.where("id % 6 = 1").select("id", F.lit("lost").alias("error"))).select("id", "status", "attempts")


@query("SELECT event_id AS id, event_type AS source_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 25 OFFSET 50")
def queue_page(spark, sf_dir):
    return Q.page(D.queue(spark, sf_dir), 50, 25, newest=True).select("id", "source_type")


@query("""SELECT 'user:' || user_id AS source_id, id FROM (SELECT user_id, arg_max(event_id, ts) AS id FROM events GROUP BY user_id)
WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'click' AND user_id % 2 = 0) AND NOT (user_id % 5 = 0 AND id % 2 = 0)""")
def queue_enqueue(spark, sf_dir):
    q = D.queue(spark, sf_dir)
    user = F.substring("source_id", 6, 20).cast("long")
    new = q.withColumn("operation", F.when(F.col("id") % 2 == 0, "created").otherwise("modified")).drop("status", "attempts")
    return Q.enqueue(q.where("source_type = 'click'").where(user % 2 == 0), new, q.where(user % 5 == 0).select("source_id")).select("source_id", "id")


@query("SELECT o_custkey AS event_id, count(DISTINCT o_orderstatus) AS n FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1")
def calendar_collisions(spark, sf_dir):
    return writers.collisions(D.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderstatus").alias("calendar_id")))


# --- sessions and chunks


def recursive_windows(messages: str, most: int = sessions.MOST, overlap: int = sessions.OVERLAP, gap: int = sessions.GAP) -> str:
    """SQL (key, session, first, last) of token windows over (key, sent, pos, text): one step of the recursion is one message of each key."""
    return f"""RECURSIVE m AS (SELECT *, row_number() OVER w AS rn, sum(CASE WHEN length(coalesce(text, '')) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END) OVER w AS upto,
    coalesce(sent - lag(sent) OVER w > {gap}, FALSE) AS apart FROM ({messages}) WINDOW w AS (PARTITION BY key ORDER BY sent, pos ROWS UNBOUNDED PRECEDING)),
walk AS (SELECT key, rn, rn AS first, 0::BIGINT AS session, 0 AS window_no, FALSE AS cut FROM m WHERE rn = 1
  UNION ALL SELECT m.key, m.rn, CASE WHEN m.apart THEN m.rn WHEN m.upto - coalesce(b.upto, 0) >= {most} THEN greatest(walk.first, m.rn - {overlap}) ELSE walk.first END,
    walk.session + m.apart::INT, CASE WHEN m.apart THEN 0 WHEN m.upto - coalesce(b.upto, 0) >= {most} THEN walk.window_no + 1 ELSE walk.window_no END, m.apart OR m.upto - coalesce(b.upto, 0) >= {most}
  FROM walk JOIN m ON m.key = walk.key AND m.rn = walk.rn + 1 LEFT JOIN m b ON b.key = walk.key AND b.rn = walk.first - 1),
bounds AS (SELECT * FROM (SELECT *, coalesce(lead(cut) OVER (PARTITION BY key ORDER BY rn), TRUE) AS ends FROM walk) WHERE ends)"""


@query("""WITH g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id)::BIGINT AS session FROM g)
SELECT user_id, session, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS messages FROM s GROUP BY 1, 2""")
def session_windows(spark, sf_dir):
    return sessions.sessions(D.table(spark, sf_dir, "events"), "user_id")


@query(f"""WITH {recursive_windows("SELECT conv_id AS key, turn * 60.0 AS sent, turn AS pos, text FROM conversations")}
SELECT key, session, window_no::INT AS "window", (bounds.rn - first + 1)::INT AS messages, f.pos AS first_pos, l.pos AS last_pos
FROM bounds JOIN m f USING (key) JOIN m l USING (key) WHERE f.rn = bounds.first AND l.rn = bounds.rn""")
def token_windows(spark, sf_dir):
    rows = D.table(spark, sf_dir, "conversations").withColumn("at", F.col("turn") * 60.0)
    return sessions.token_windows(rows, "conv_id", "turn", "at")


CHAT_CHANGES = """SELECT conv_id::VARCHAR AS channel, turn::VARCHAR AS message, turn * 900.0 AS sent, 0.0 AS version, FALSE AS gone, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT conv_id::VARCHAR, turn::VARCHAR, turn * 900.0, 1.0, turn % 4 = 3, 'edited ' || coalesce(text, '') FROM conversations WHERE turn % 4 IN (1, 3)"""


def chat_changes(spark, sf_dir):
    """Conversations as channels: every fourth turn is edited, every fourth deleted."""
    posted = D.table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("channel"), F.col("turn").cast("string").alias("message"), (F.col("turn") * 900.0).alias("at"), F.lit(0.0).alias("version"), F.lit(False).alias("gone"), F.coalesce("text", F.lit("")).alias("text"))
    turn = F.col("message").cast("long") % 4
    return posted.union(posted.where(turn.isin(1, 3)).withColumns({"version": F.lit(1.0), "gone": turn == 3, "text": F.concat(F.lit("edited "), "text")}))


@query(f"""WITH {recursive_windows(f"SELECT channel AS key, sent, message AS pos, now[3] AS text FROM (SELECT channel, message, sent, max(row(version, gone, text)) AS now FROM ({CHAT_CHANGES}) WHERE sent IS NOT NULL AND channel IS NOT NULL GROUP BY ALL) WHERE NOT now[2]", most=300)}
SELECT key AS channel, printf('window/%.6f%s-%.6f%s', min(m.sent), min_by(m.pos, m.rn), max(m.sent), max_by(m.pos, m.rn)) AS window_id, min(m.sent)::DOUBLE AS first_at, max(m.sent)::DOUBLE AS last_at,
  count(*)::INT AS messages, string_agg(m.text, chr(10) ORDER BY m.rn) AS text FROM bounds JOIN m USING (key) WHERE m.rn BETWEEN bounds.first AND bounds.rn GROUP BY key, bounds.rn""")
def chat_windows(spark, sf_dir):
    return chats.chat_windows(chat_changes(spark, sf_dir), most=300)


@query()
def chunk_documents(spark, sf_dir):
    return chunking.chunks(D.table(spark, sf_dir, "documents"), id_col="doc_id")


@query()
def chunk_messages(spark, sf_dir):
    threads = D.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda m: F.concat(F.lit("[10:00 UTC] "), m["role"], F.lit(": "), m["text"])), "\n").alias("text"))
    return chunking.chunks(threads, chunking.chunk_messages, id_col="conv_id")


@query("SELECT conv_id, turn, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, length(text) // 4) END::INT AS tokens FROM conversations")
def token_estimates(spark, sf_dir):
    return D.table(spark, sf_dir, "conversations").select("conv_id", "turn", T.token_estimate(F.col("text")).alias("tokens"))


# --- scalar functions

MAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"


@query(f"SELECT DISTINCT doc_id, lower(m) AS email FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{MAIL}')) AS m FROM documents)")
def email_extract(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", F.explode(T.emails(F.col("text"))).alias("email"))


@query("SELECT c_custkey, 'u' || (c_custkey % 400) || '@gmail.com' AS email FROM customer")
def email_canonical(spark, sf_dir):
    return D.persons(spark, sf_dir).select("c_custkey", T.canonical_email(F.col("email")).alias("email"))


@query(f"SELECT DISTINCT 'doc:' || doc_id AS src_id, 'person:' || lower(m) AS dst_id, 'MENTIONS' AS rel FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{MAIL}')) AS m FROM documents)")
def mention_edges(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").selectExpr("concat('doc:', doc_id) AS source_id", "text")
    return parsers.mentions(docs, "File").where("rel = 'MENTIONS'").select("src_id", "dst_id", "rel")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'omnifocus://' || page_id WHEN 1 THEN 'gmail://a/message/' || page_id ELSE 'slack://T1/C9/1715800000.' || lpad(page_id::VARCHAR, 6, '0') END AS object_id, CASE page_id % 3 WHEN 0 THEN 'Task' WHEN 1 THEN 'Email' ELSE 'SlackMessage' END AS object_label FROM pages")
def link_extract(spark, sf_dir):
    text = "CASE page_id % 3 WHEN 0 THEN concat('see omnifocus://task/', page_id, '.') WHEN 1 THEN concat('gmail://a/message/', page_id, ') gmail://a/message/', page_id) ELSE concat('https://Terra.slack.com/archives/C9/p1715800000', lpad(page_id, 6, '0'), '?thread_ts=1 ok') END AS text"
    pages = D.table(spark, sf_dir, "pages").selectExpr("page_id", text)
    return pages.select("page_id", F.explode(T.source_links(F.col("text"), teams={"terra": "T1"})).alias("l")).select("page_id", "l.*")


@query("SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1) AS path FROM pages")
def url_parts(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PATH")).alias("path"))


def _entities(sql: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        sql = f"replace({sql}, '{a}', '{b}')"
    return sql


BARE = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g'), '(?is)<!--.*?-->', '', 'g'), '(?is)<!DOCTYPE[^>]*>', '', 'g')"


@query(f"SELECT page_id, array_to_string(list_filter(list_transform(regexp_split_to_array({_entities(f'''regexp_replace({BARE}, '(?s)<[^>]*>', chr(10), 'g')''')}, '\\r\\n|\\r|\\n'), lambda x: regexp_replace(x, '^[\\s ]+|[\\s ]+$', '', 'g')), lambda x: x <> ''), chr(10)) AS text FROM pages")
def html_strip(spark, sf_dir):
    return D.table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def props_json(spark, sf_dir):
    return D.table(spark, sf_dir, "events").select("event_id", F.variant_get(F.parse_json("props"), "$.k", "bigint").alias("k"))


@query("SELECT doc_id, CASE WHEN length(text) > 256 THEN substr(text, 1, 247) || '_' || substr(sha256(text), 1, 8) ELSE text END AS name FROM documents")
def name_truncate(spark, sf_dir):
    return D.table(spark, sf_dir, "documents").select("doc_id", T.short_name(F.col("text")).alias("name"))


@query("""SELECT o_orderkey, CASE WHEN b >= 1073741824 THEN printf('%.1f GB', b / 1073741824.0) WHEN b >= 1048576 THEN printf('%.1f MB', b / 1048576.0) WHEN b >= 1024 THEN printf('%.1f KB', b / 1024.0) WHEN b <= 0 THEN '0 B' ELSE b || ' B' END AS size FROM (SELECT o_orderkey, o_orderkey * o_orderkey * 7 AS b FROM orders)""")
def human_size(spark, sf_dir):
    return D.table(spark, sf_dir, "orders").select("o_orderkey", T.human_size(F.col("o_orderkey") * F.col("o_orderkey") * 7).alias("size"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_size * 1000000 <= 26214400 THEN 'download_and_index' ELSE 'metadata_only' END AS decision FROM part")
def attachment_policy(spark, sf_dir):
    mime = F.when(F.col("p_partkey") % 3 == 0, " Application/PDF; charset=x").otherwise("application/zip")
    return D.table(spark, sf_dir, "part").select("p_partkey", filters.attachment_decision(mime, F.col("p_size") * 1000000, ["application/pdf"]).alias("decision"))


@query("SELECT event_id, ts AS at FROM events")
def mixed_times(spark, sf_dir):
    """Three stored forms of one time come back as that time."""
    e = D.table(spark, sf_dir, "events")
    t = F.col("ts").cast("timestamp")
    form = F.when(F.col("event_id") % 3 == 0, F.format_string("%d.%06d", F.floor(F.unix_micros(t) / 1000000).cast("long"), F.unix_micros(t) % 1000000)).when(F.col("event_id") % 3 == 1, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    return e.select("event_id", times.mixed_timestamp(form).cast("timestamp_ntz").alias("at"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-09 23:00:00' AND ts < TIMESTAMP '2024-01-10 23:00:00'")
def local_day_window(spark, sf_dir):
    import datetime

    start = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return D.table(spark, sf_dir, "events").where(times.starts_in_window(start, datetime.date(2024, 1, 10), "Europe/Berlin")).select("event_id")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'exclude' WHEN doc_id % 4 = 1 THEN 'index_only' ELSE 'normal' END AS tag FROM documents")
def queue_retag(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, ("/h/node_modules/a.js", "/h/Library/Uni/ü.pdf", "/h/notes/b.md", "/h/LibraryUni/c.pdf"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return filters.retag(D.table(spark, sf_dir, "documents").select("doc_id", path.alias("source_id")), ["node_modules/"], ["Library/Uni"]).select("doc_id", "tag")


# --- answers, images, descriptions


@query(r"SELECT conv_id, turn, turn > 0 AND regexp_matches(text, '(?i)\b(it|that|this|them|those|these|more|also|first|second|third|fourth|fifth|last|previous|above|mentioned)\b') AS refers_back FROM conversations")
def context_questions(spark, sf_dir):
    return D.table(spark, sf_dir, "conversations").select("conv_id", "turn", answers.refers_back(F.col("text"), F.col("turn")).alias("refers_back"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Concept' ELSE 'Project' END AS type, CASE WHEN event_id % 4 = 0 THEN 0.75 ELSE least(event_id % 4, 1) END::DOUBLE AS confidence FROM events WHERE event_id % 5 <> 0")
def extracted_entities(spark, sf_dir):
    name = "IF(event_id % 5 = 0, '5', concat('\"n', event_id, '\"'))"
    said = F.expr(f"concat('{{\"entities\":[7,{{\"name\":', {name}, ',\"type\":\"', IF(event_id % 3 = 0, 'Zebra', 'Project'), '\"', IF(event_id % 4 = 0, '', concat(',\"confidence\":', event_id % 4)), '}}]}}')")
    return D.table(spark, sf_dir, "events").select("event_id", F.explode(answers.entities(said)).alias("e")).select("event_id", "e.type", "e.confidence")


@query("SELECT c_custkey AS image, s_suppkey AS place FROM customer JOIN supplier ON c_custkey % 500 = s_suppkey % 500 AND c_nationkey = s_nationkey")
def images_at_places(spark, sf_dir):
    images = D.table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "(c_custkey % 500) * 0.004D + 0.0003D AS lat", "c_nationkey * 0.003D AS lon")
    places = D.table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "(s_suppkey % 500) * 0.004D AS lat", "s_nationkey * 0.003D AS lon")
    return graph.taken_at(images, places)


@query("SELECT p_partkey AS app, CASE WHEN p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 AND NOT (p_partkey % 5 = 0 AND p_partkey % 2 = 0) THEN CASE WHEN p_partkey % 5 = 0 THEN 'Unknown application' ELSE p_brand END END AS description FROM part")
def description_cache(spark, sf_dir):
    part = D.table(spark, sf_dir, "part")
    apps = part.selectExpr("p_partkey AS app", "p_name AS name", "'2.1' AS version")
    cache = part.where("p_partkey % 7 <> 0").selectExpr("p_partkey AS app", "IF(p_partkey % 2 = 0, 'old', p_name) AS name", "IF(p_partkey % 3 = 0, '1.9', '2.0.4') AS version", "IF(p_partkey % 5 = 0, 'Unknown application', p_brand) AS description")
    return clustering.cached_descriptions(apps, cache).select("app", "description")
