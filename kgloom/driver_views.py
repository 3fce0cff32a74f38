"""The driver's tables in the roles of the graph's: orders as mails, lineitem as tasks, documents as files, events as commits or messages, parts as applications, brands as topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def activity(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    t = lambda n: table(spark, sf_dir, n)
    return {
        "files": t("documents").selectExpr("concat('doc:', doc_id) AS source_id", "concat('Doc ', doc_id) AS title", "cast(null AS string) AS name", "timestamp_ntz'1995-01-01' + make_dt_interval(0, cast(doc_id AS int)) AS created", "timestamp_ntz'1995-01-01' + make_dt_interval(cast(doc_id % 3 AS int), cast(doc_id AS int)) AS updated", "cast(null AS timestamp_ntz) AS indexed_at"),
        "tasks": t("lineitem").selectExpr("concat('task:', l_orderkey, ':', l_linenumber) AS source_id", "concat('Line ', l_linenumber, ' of ', l_orderkey) AS name", "IF(l_linestatus = 'F', 'completed', 'active') AS status", "l_shipdate - make_dt_interval(IF(l_linenumber = 1, 0, 3)) AS creation_date", "l_shipdate AS modification_date", "IF(l_linestatus = 'F', l_shipdate + make_dt_interval(1), null) AS completion_date"),
        "mails": t("orders").selectExpr("concat('mail:', o_orderkey) AS source_id", "concat('Order ', o_orderkey) AS subject", "o_orderdate AS date"),
        "commits": t("events").selectExpr("concat('event:', event_id) AS source_id", "concat(event_type, '\\n', props) AS message", "ts AS date"),
        "apps": t("part").selectExpr("concat('part:', p_partkey) AS source_id", "p_name AS name", "timestamp_ntz'1996-01-01' + make_dt_interval(0, cast(p_partkey AS int)) AS indexed_at"),
    }


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers SENT mails, mails MENTION suppliers and are TAGGED with brands."""
    lines = table(spark, sf_dir, "lineitem")
    sent = table(spark, sf_dir, "orders").selectExpr("'Person' AS src_label", "concat('cust:', o_custkey) AS src_id", "'SENT' AS rel", "'Email' AS dst_label", "concat('mail:', o_orderkey) AS dst_id")
    named = lines.selectExpr("'Email' AS src_label", "concat('mail:', l_orderkey) AS src_id", "'MENTIONS' AS rel", "'Person' AS dst_label", "concat('supp:', l_suppkey) AS dst_id").distinct()
    tagged = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr("'Email' AS src_label", "concat('mail:', l_orderkey) AS src_id", "'TAGGED' AS rel", "'Topic' AS dst_label", "p_brand AS dst_id").distinct()
    return sent.unionByName(named).unionByName(tagged)


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("event_id AS id", "event_type AS source_type", "concat('user:', user_id) AS source_id", "CASE event_type WHEN 'click' THEN 'pending' WHEN 'view' THEN 'processing' WHEN 'error' THEN 'failed' ELSE 'done' END AS status", "cast(event_id % 4 AS int) AS attempts", "cast(null AS string) AS error", "ts AS enqueued_at")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").selectExpr("concat('v', lpad(vec_id, 6, '0')) AS source_id", "concat('t', label) AS source_type", "0 AS chunk_index", "embedding AS vector", "label", "vec_id")


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, with addresses that several share in different spellings."""
    return table(spark, sf_dir, "customer").selectExpr("concat('cust:', lpad(c_custkey, 8, '0')) AS source_id", "c_name AS name", "concat(' U', c_custkey % 400, IF(c_custkey % 2 = 0, '+x@GoogleMail.com', '@gmail.com')) AS email", "c_custkey")
