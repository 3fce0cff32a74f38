"""Chat sessions: by gap in window functions, by token budget in order within a session, and on a stream (with edits and deletions: ``chats``)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunking import split_windows
from ..functions.text import token_estimate

GAP, MOST, OVERLAP = 1800, 512, 3


MICROS = 1_000_000


def _numbered(slots: DataFrame, by: str, gap: int) -> DataFrame:
    """``slots`` (by, _slot, _first, _last, ...) with their session, from 0. Slots are as long as the gap, so messages of one slot are of one session, and a slot
    begins another if its first message is further from the last one before it than the gap. The window runs over a small row a slot, not over a hot key's messages."""
    w = Window.partitionBy(by).orderBy("_slot")
    begins = F.coalesce((F.col("_first") - F.lag("_last").over(w) > gap * MICROS).cast("int"), F.lit(0))
    return slots.withColumn("session", F.sum(begins).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def _micros(messages: DataFrame, ts: str) -> Column:
    """A time, or a number of seconds, in microseconds."""
    if dict(messages.dtypes)[ts].startswith("timestamp"):
        return F.unix_micros(F.col(ts).cast("timestamp"))
    return F.round(F.col(ts).cast("double") * MICROS).cast("long")


def gap_sessions(messages: DataFrame, by: str, ts: str = "ts", gap: int = GAP) -> DataFrame:
    """``messages`` with the number of their session, from 0: a gap of more than ``gap`` seconds begins another; ``ts`` is a time or a number of seconds.

    Partial minima and maxima of slots are made before the shuffle. Messages without a time are in session 0.
    """
    at = _micros(messages, ts)
    timed = messages.withColumn("_slot", F.floor(at / (gap * MICROS)))
    slots = _numbered(timed.groupBy(by, "_slot").agg(F.min(at).alias("_first"), F.max(at).alias("_last")), by, gap).select(F.col(by).alias("_by"), F.col("_slot").alias("_of"), "session")
    return timed.join(slots, F.col(by).eqNullSafe(F.col("_by")) & F.col("_slot").eqNullSafe(F.col("_of"))).drop("_slot", "_by", "_of")


def sessions(messages: DataFrame, by: str, ts: str = "ts", gap: int = GAP) -> DataFrame:
    """One row for each session: first and last time, messages. Counted by slot before anything is put in order."""
    at = _micros(messages, ts)
    slots = messages.groupBy(by, F.floor(at / (gap * MICROS)).alias("_slot")).agg(F.min(at).alias("_first"), F.max(at).alias("_last"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.count("*").alias("messages"))
    return _numbered(slots, by, gap).groupBy(by, "session").agg(F.min("first_ts").alias("first_ts"), F.max("last_ts").alias("last_ts"), F.sum("messages").cast("long").alias("messages"))


def token_windows(messages: DataFrame, by: str, pos: str, seconds: str, text: str = "text", most: int = MOST, overlap: int = OVERLAP, gap: int = GAP) -> DataFrame:
    """(by, window, messages, first, last) by gap and token budget. State is sequential within a session, so gaps are cut first and a session is a group."""
    s = messages.select(F.col(by).alias("key"), F.col(pos).cast("long").alias("pos"), F.col(seconds).cast("double").alias("at"), F.col(text).alias("text"))
    cut = gap_sessions(s, "key", "at", gap=gap)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["at", "pos"]).reset_index(drop=True)
        found = split_windows(group["at"].tolist(), group["text"].tolist(), gap, most, overlap)
        rows = [(group["key"][0], int(group["session"][0]), k, len(x), int(group["pos"][x[0]]), int(group["pos"][x[-1]])) for k, x in enumerate(found)]
        return pd.DataFrame(rows, columns=["key", "session", "window", "messages", "first_pos", "last_pos"])

    return cut.groupBy("key", "session").applyInPandas(run, "key long, session long, window int, messages int, first_pos long, last_pos long")


def stream_sessions(messages: DataFrame, by: str, late: str = "1 hour") -> DataFrame:
    """Sessions on a stream, given out once the watermark has passed them. Its gap is not strict: messages exactly 30 minutes apart are parted."""
    return messages.withWatermark("ts", late).groupBy(F.session_window("ts", f"{GAP} seconds").alias("w"), by).agg(F.count("*").alias("messages"), F.sum(token_estimate(F.col("text"))).alias("tokens")).select(by, F.col("w.start").alias("first_ts"), F.col("w.end").alias("closes_at"), "messages", "tokens")
