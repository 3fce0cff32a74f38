"""Queries over the driver's tables for search, fuzzy words, notes, packages and budgets, each with DuckDB SQL written from the operator's rule."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import driver_views as D
from .operators import fulltext, ranked_words, queue as Q
from .plans import search
from .queries import COS, VEC, query
from .sources import parsers

FOUND = f"""WITH {VEC}, g AS (SELECT source_id, row_number() OVER (ORDER BY source_id) AS pos FROM v WHERE vec_id % 50 = 0 AND label < 4),
h AS (SELECT source_id, source_type, score, row_number() OVER (ORDER BY score DESC, source_id) AS pos FROM (SELECT v.source_id, v.source_type, {COS.format(a='v.vector', b='q.vector')} AS score FROM v, (SELECT vector FROM v WHERE vec_id = 0) q) ORDER BY pos LIMIT 30),
f AS (SELECT 0 AS lane, pos, source_id, NULL AS source_type, 'row ' || pos AS line FROM g UNION ALL SELECT 1, pos, source_id, source_type, 'text of ' || source_id FROM h WHERE source_id NOT IN (SELECT source_id FROM g))"""


def _found(spark, sf_dir):
    from pyspark.sql import Window

    vectors = D.vectors(spark, sf_dir).withColumn("text", F.concat(F.lit("text of "), "source_id")).withColumn("date", F.lit(""))
    pos = F.row_number().over(Window.orderBy("source_id"))  # the graph's few rows
    graph = vectors.where("vec_id % 50 = 0 AND label < 4").select(pos.alias("pos"), "source_id").withColumn("line", F.concat(F.lit("row "), "pos"))
    asked = [float(x) for x in D.table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]
    return search.search("what is like the first one", graph, vectors, lambda texts: [asked for _ in texts], k=30)


@query(FOUND + " SELECT lane, pos::INT AS pos, source_id, source_type, line FROM f")
def search_results(spark, sf_dir):
    return _found(spark, sf_dir).select("lane", "pos", "source_id", "source_type", "line")


@query(FOUND + " SELECT row_number() OVER (ORDER BY lane, pos)::INT AS pos, source_id FROM (SELECT min(lane) AS lane, min(pos) AS pos, source_id FROM f GROUP BY source_id)")
def search_sources(spark, sf_dir):
    return search.ordered_ids(_found(spark, sf_dir))


@query(FOUND + """ SELECT array_to_string(list_filter([
CASE WHEN (SELECT count(*) FROM g) > 0 THEN '[Graph context]' || chr(10) || (SELECT string_agg('- ' || line, chr(10) ORDER BY pos) FROM f WHERE lane = 0) END,
CASE WHEN (SELECT count(*) FROM f WHERE lane = 1) > 0 THEN '[Semantic context]' || chr(10) || (SELECT string_agg('- [' || source_type || '] ' || source_id || chr(10) || '  ' || line, chr(10) ORDER BY pos) FROM f WHERE lane = 1) END,
'[Sources]' || chr(10) || (SELECT string_agg(source_id, chr(10) ORDER BY lane, pos) FROM f)], lambda x: x IS NOT NULL), chr(10) || chr(10)) AS text""")
def search_text(spark, sf_dir):
    return search.search_page(_found(spark, sf_dir))


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 25")
def unchanged_rank(spark, sf_dir):
    return search.first_rows(D.table(spark, sf_dir, "events").select("event_id"), 25, "event_id")


WORDS = "list_distinct(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))"


@query(f"""WITH q AS (SELECT s_suppkey, unnest({WORDS.format('s_name')}) AS word FROM supplier),
e AS (SELECT name, unnest({WORDS.format('name')}) AS near FROM (SELECT c_name AS name FROM customer UNION SELECT p_name FROM part)), n AS (SELECT DISTINCT near FROM e), u AS (SELECT DISTINCT word FROM q),
m AS (SELECT word, near FROM u, n WHERE levenshtein(word, near) <= 2 AND levenshtein(word, near) < least(length(word), length(near)))
SELECT s_suppkey, count(DISTINCT name) AS n, min(name) AS first, max(name) AS last, 'Concept' AS kind, 0.75::DOUBLE AS least FROM q JOIN m ON q.word = m.word JOIN e ON e.near = m.near GROUP BY s_suppkey""")
def entity_candidates(spark, sf_dir):
    """ASCII names, as DuckDB counts edits in bytes."""
    names = D.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    known = D.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).unionByName(D.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))).distinct()
    entities = known.withColumn("type", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    found = fulltext.candidates(names, fulltext.word_index(known), entities, ["s_suppkey"])
    return found.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.min("name").alias("first"), F.max("name").alias("last"), F.min("type").alias("kind"), F.min("confidence").alias("least"))


NOTE = "concat('---\\ntitle: \"Doc ', doc_id, '\"\\naliases: [A', doc_id, ', ''b c'']\\ntags:\\n  - #', lang, '\\n  - x\\ncategories: ', coalesce(source, ''), '\\nemails: U', doc_id, '+z@googlemail.com, no\\n---\\n', coalesce(text, ''))"


@query("""SELECT 'v/' || doc_id || '.md' AS source_id, 'Doc ' || doc_id AS title, 'A' || doc_id || '|b c' AS aliases, coalesce(source, '') AS categories, lang || '|x' AS tags, 'u' || doc_id || '@gmail.com' AS emails, false AS web_clip FROM documents""")
def note_properties(spark, sf_dir):
    files = D.table(spark, sf_dir, "documents").select(F.expr("concat('v/', doc_id, '.md')").alias("source_id"), F.expr(NOTE).alias("text"))
    joined = [F.array_join(c, "|").alias(c) for c in ("aliases", "categories", "tags", "emails")]
    return parsers.note_properties(files).select("source_id", "title", *joined, "web_clip")


@query("SELECT l_orderkey, count(*) AS intended, count(*) FILTER (l_linenumber % 3 = 0) AS indexed, count(*) FILTER (l_linenumber % 3 <> 0) AS metadata_only FROM lineitem GROUP BY l_orderkey")
def attachment_counters(spark, sf_dir):
    rows = D.table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "IF(l_linenumber % 3 = 0, true, IF(l_linenumber = 1, null, false)) AS indexed")
    return parsers.attachment_counters(rows, "l_orderkey")


@query("""SELECT 'pkg:' || p_partkey AS src_id, 'PROVIDES' AS rel, 'command:' || b AS dst_id FROM (SELECT p_partkey, unnest([p_brand, 'x' || p_size]) AS b FROM part WHERE p_size % 2 = 0)
UNION ALL SELECT 'pkg:' || p_partkey, 'INSTALLED_VIA', CASE WHEN p_size % 2 = 0 THEN 'source:brew_formula' ELSE 'source:brew_cask' END FROM part UNION ALL SELECT 'pkg:' || p_partkey, 'SAME_AS', 'app://' || p_brand FROM part WHERE p_size % 2 = 1 AND p_size % 3 = 0""")
def package_edges(spark, sf_dir):
    rows = D.table(spark, sf_dir, "part").selectExpr("concat('pkg:', p_partkey) AS source_id", "IF(p_size % 2 = 0, 'formula', 'cask') AS kind", "array(p_brand, concat('x', p_size)) AS binaries", "IF(p_size % 3 = 0, p_brand, null) AS bundle_id")
    return parsers.packages(rows).select("src_id", "rel", "dst_id")


@query("SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN ' (v' || p_size || ')' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN ' — ' || p_brand ELSE '' END AS text FROM part")
def package_texts(spark, sf_dir):
    version, told = F.expr("IF(p_size % 2 = 0, cast(p_size AS string), null)"), F.expr("IF(p_size % 3 = 0, p_brand, '')")
    return D.table(spark, sf_dir, "part").select("p_partkey", parsers.package_text(F.col("p_name"), version, told).alias("text"))


@query("""SELECT event_id, recent, recent > 3 AS over FROM (SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS recent FROM events)""")
def request_rate(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").select("event_id", "event_type", F.col("ts").alias("at"))
    return Q.request_rate(rows, 3, "event_type").select("event_id", "recent", "over")


@query("""SELECT event_type, day, used, CASE WHEN used >= 20000 THEN 'exhausted' WHEN used >= 16000 THEN 'warned' ELSE 'ok' END AS state FROM (SELECT event_type, ts::DATE AS day, sum(user_id)::BIGINT AS used FROM events GROUP BY 1, 2)""")
def token_budget(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").select("event_type", F.col("ts").alias("at"), F.col("user_id").alias("tokens"))
    return Q.token_budget(rows, 20_000, "event_type")


@query("SELECT 'e' || event_id AS key, CASE WHEN event_id % 7 = 0 THEN 'old' ELSE props END AS value FROM events WHERE event_id % 7 = 0 OR event_id % 3 <> 0")
def imported_cursors(spark, sf_dir):
    events = D.table(spark, sf_dir, "events")
    files = events.selectExpr("concat('e', event_id) AS key", "IF(event_id % 3 = 0, concat(props, '}'), props) AS value")
    return Q.import_cursors(events.where("event_id % 7 = 0").selectExpr("concat('e', event_id) AS key", "'old' AS value"), files)


@query("SELECT 'b' || n_nationkey AS name FROM nation WHERE n_nationkey < 18")
def pruned_archives(spark, sf_dir):
    rows = D.table(spark, sf_dir, "nation").selectExpr("concat('b', n_nationkey) AS name", "timestamp_seconds(n_nationkey * 86400) AS created_at")
    return Q.to_prune(rows, 7).select("name")


ALL_WORDS = "list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


@query(f"""WITH q AS (SELECT DISTINCT s_suppkey, unnest({ALL_WORDS.format('s_name')}) AS word FROM supplier),
d AS (SELECT name, {ALL_WORDS.format('name')} AS ws FROM (SELECT c_name AS name FROM customer UNION SELECT p_name FROM part) WHERE len({ALL_WORDS.format('name')}) > 0),
p AS (SELECT name, len(ws) AS n, word AS near, count(*) AS times FROM (SELECT name, ws, unnest(ws) AS word FROM d) GROUP BY ALL),
f AS (SELECT near, count(*) AS names FROM p GROUP BY near), t AS (SELECT count(*) AS every, avg(len(ws)) AS mean FROM d),
m AS (SELECT word, near, names, damerau_levenshtein(word, near) AS edits FROM (SELECT DISTINCT word FROM q), f WHERE damerau_levenshtein(word, near) <= 2 AND damerau_levenshtein(word, near) < least(length(word), length(near))),
s AS (SELECT s_suppkey, name, sum((1 - edits / least(length(word), length(near))) * ln(1 + (every - names + 0.5::DOUBLE) / (names + 0.5)) * times * 2.2::DOUBLE / (times + 1.2 * (0.25 + 0.75 * n / mean))) AS score FROM q JOIN m USING (word) JOIN p USING (near), t GROUP BY ALL)
SELECT s_suppkey, count(name) AS n, round(sum(score), 4) AS total, round(max(score), 6) AS best FROM (SELECT DISTINCT s_suppkey FROM supplier) LEFT JOIN s USING (s_suppkey) GROUP BY s_suppkey""")
def ranked_candidates(spark, sf_dir):
    """As ``entity_candidates`` with exchanges as one edit and BM25 scores. DuckDB's distance may edit a part twice; that differs for words like "ca" and "abc" alone, which these tables lack."""
    names = D.table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("name"))
    known = D.table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).unionByName(D.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))).distinct()
    entities = known.withColumn("type", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    found = ranked_words.candidates(names, ranked_words.build(known), entities, ["s_suppkey"])
    return found.groupBy("s_suppkey").agg(F.count("name").alias("n"), F.round(F.sum("score"), 4).alias("total"), F.round(F.max("score"), 6).alias("best"))
