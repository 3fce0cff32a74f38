"""The ingest queue as a table: enqueue with skips, claim, retry, statistics, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .writers import latest

MOST_ATTEMPTS = 3
WAITING = ("pending", "processing")


def enqueue(queue: DataFrame, events: DataFrame, indexed: DataFrame) -> DataFrame:
    """Events that join the queue: none whose source waits already, no ``created`` that is indexed already, one for each source (the last)."""
    one = latest(events, ["source_id"], F.desc("enqueued_at"))
    free = one.join(queue.where(F.col("status").isin(*WAITING)).select("source_id"), "source_id", "left_anti")
    known = indexed.select("source_id").distinct().withColumn("_known", F.lit(True))
    new = free.join(known, "source_id", "left").where(~((F.col("operation") == "created") & F.coalesce("_known", F.lit(False)))).drop("_known")
    return new.withColumn("status", F.lit("pending")).withColumn("attempts", F.lit(0))


def claim(queue: DataFrame, n: int = 1) -> DataFrame:
    return queue.where("status = 'pending'").orderBy("enqueued_at", "id").limit(n)


def finish(queue: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """Done rows go; failed ones (id, error) wait again until their third attempt."""
    left = queue.join(done.select("id"), "id", "left_anti").join(failed.select("id", F.col("error").alias("_error")), "id", "left")
    missed = F.col("_error").isNotNull()
    attempts = F.col("attempts") + missed.cast("int")
    status = F.when(missed, F.when(attempts < MOST_ATTEMPTS, "pending").otherwise("failed")).otherwise(F.col("status"))
    return left.withColumn("status", status).withColumn("attempts", attempts).withColumn("error", F.coalesce("_error", "error")).drop("_error").select(*queue.columns)


def recover(queue: DataFrame) -> DataFrame:
    """After a crash what was in work waits again."""
    return queue.withColumn("status", F.when(F.col("status") == "processing", "pending").otherwise(F.col("status")))


def retry(queue: DataFrame) -> DataFrame:
    failed = F.col("status") == "failed"
    return queue.withColumn("attempts", F.when(failed, 0).otherwise(F.col("attempts"))).withColumn("status", F.when(failed, "pending").otherwise(F.col("status")))


def purge(queue: DataFrame, status: str) -> DataFrame:
    return queue.where(F.col("status") != status)


def stats(queue: DataFrame) -> DataFrame:
    return queue.groupBy("source_type", "status").agg(F.count("*").alias("n"))


def depth(queue: DataFrame) -> DataFrame:
    return queue.agg(F.count_if(F.col("status").isin(*WAITING)).alias("depth"))


def page(queue: DataFrame, offset: int, limit: int, newest: bool = False) -> DataFrame:
    order = [F.desc("enqueued_at"), F.desc("id")] if newest else [F.asc("enqueued_at"), F.asc("id")]
    return queue.orderBy(*order).offset(offset).limit(limit)


def eta_seconds(durations: DataFrame, waiting: Column) -> DataFrame:
    """Mean of the last 50 durations times what waits."""
    return durations.orderBy(F.desc("finished_at")).limit(50).agg((F.avg("seconds") * waiting).alias("eta"))


def failures(log: DataFrame, source_type: str | None = None, limit: int = 50) -> DataFrame:
    rows = log if source_type is None else log.where(F.col("source_type") == source_type)
    return rows.orderBy(F.desc("id")).limit(limit)


def counters(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.sum("n").alias("n")).where("n > 0")


#: Requests are counted over this many seconds up to and with each one.
LIMIT_SECONDS = 60
#: Shares of a day's tokens at which the budget warns and ends.
WARN_SHARE, HARD_SHARE = 0.80, 1.00


def request_rate(requests: DataFrame, per_minute: int, *by: str) -> DataFrame:
    """Requests (``at`` timestamp) with the number within the last 60 seconds, themselves included, and whether that is more than allowed."""
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    recent = Window.partitionBy(*by).orderBy(micros).rangeBetween(-LIMIT_SECONDS * 1_000_000 + 1, 0)
    return requests.withColumn("recent", F.count("*").over(recent)).withColumn("over", F.col("recent") > per_minute)


def token_budget(requests: DataFrame, daily: int, *by: str) -> DataFrame:
    """Tokens used on each UTC day (``at``, ``tokens``) and the state of the budget: ok, warned, exhausted."""
    used = requests.groupBy(*by, F.to_date("at").alias("day")).agg(F.sum("tokens").alias("used"))
    share = F.col("used") / F.lit(float(daily))
    return used.withColumn("state", F.when(share >= HARD_SHARE, "exhausted").when(share >= WARN_SHARE, "warned").otherwise("ok"))


def import_cursors(cursors: DataFrame, files: DataFrame) -> DataFrame:
    """Cursors (key, value) with those of old files that are valid JSON and not known yet."""
    # the parser ignores what follows a value; inside of both brackets it does not
    within = lambda a, b: F.try_parse_json(F.concat(F.lit(a), "value", F.lit(b))).isNotNull()
    valid = files.where(within("[", "]") & within('{"x":', "}")).select("key", "value")
    return cursors.select("key", "value").unionByName(valid.join(cursors.select("key"), "key", "left_anti"))


def to_prune(archives: DataFrame, keep: int) -> DataFrame:
    """Archives (name, created_at) but for the newest ``keep``."""
    rank = F.row_number().over(Window.orderBy(F.desc("created_at"), F.desc("name")))  # a folder's few archives
    return archives.withColumn("rank", rank).where(F.col("rank") > keep).drop("rank")
