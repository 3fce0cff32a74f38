"""Line dedup by overlapping three-line windows, in DataFrame functions.

A text's lines are split at line feeds; lines that are blank are passed over and stay. Any three consecutive other lines, trimmed, make a window,
known by a 64-bit and a 32-bit hash. A document is an id and a text, the text known by its hash. A window's first occurrence is the least (doc_id, text, position) over
the whole table. All later occurrences are marked, and in each document the lines that marked windows cover are merged and removed. A removed line is always kept somewhere earlier.

Windows are aggregated before the shuffle, so a passage that many documents share costs each task one row. The repeated windows, a small part, are written
and joined back to all windows; Spark splits a hot window's part of that join.

Defined cases: a null text stays null with no lines; fewer than three lines that are not blank have no window and stay whole; rows that repeat both doc_id and text count as
one document, so they keep and lose the same lines; rows of one doc_id, or of none, with different texts are documents of their own; an empty table gives no rows; columns of ``docs`` other than doc_id and text pass through ``dedup_lines``
untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored

SPAN = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(docs: DataFrame) -> DataFrame:
    """doc_id, the text's hash, the numbers i, j, k of a window's lines and its hashes a (64 bits) and b (32 bits)."""
    trimmed = F.transform(_lines(F.col("text")), lambda line, i: F.struct(i.alias("i"), F.trim(F.translate(line, "\t\r", "  ")).alias("t")))
    hashed = F.transform(F.filter(trimmed, lambda x: x["t"] != ""), lambda x: F.struct(x["i"].alias("i"), F.xxhash64(x["t"]).alias("a"), F.hash(x["t"]).alias("b")))
    # a generator holds the array once: what follows refers to it several times
    full = docs.where(F.col("text").contains("\n")).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.explode(F.array(hashed)).alias("full"))
    part = lambda k: F.slice("full", F.lit(k + 1), F.greatest(F.size("full") - SPAN + 1, F.lit(0)))
    w = F.col("w")
    return full.select("doc_id", "hash", F.explode(F.arrays_zip(part(0).alias("x"), part(1).alias("y"), part(2).alias("z"))).alias("w")).select(
        "doc_id", "hash", w["x"]["i"].alias("i"), w["y"]["i"].alias("j"), w["z"]["i"].alias("k"), F.xxhash64(w["x"]["a"], w["y"]["a"], w["z"]["a"]).alias("a"), F.hash(w["x"]["b"], w["y"]["b"], w["z"]["b"]).alias("b")
    )


def later_windows(docs: DataFrame) -> DataFrame:
    """doc_id, hash and gone, the numbers of the lines that windows occurring earlier in the table cover."""
    every = Stored(windows(docs), "windows").df
    first = F.min(F.struct("doc_id", "hash", "i")).alias("first")
    repeated = Stored(every.groupBy("a", "b").agg(first, F.count("*").alias("n")).where("n > 1").select("a", "b", "first.*"), "repeated").df
    repeated = repeated.select(F.col("a").alias("ra"), F.col("b").alias("rb"), F.col("doc_id").alias("first_doc"), F.col("hash").alias("first_hash"), F.col("i").alias("first_line"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("hash") == F.col("first_hash")) & (F.col("i") == F.col("first_line"))
    marked = every.join(repeated, (F.col("a") == F.col("ra")) & (F.col("b") == F.col("rb"))).where(~is_first)
    return marked.groupBy("doc_id", "hash").agg(F.array_distinct(F.flatten(F.collect_set(F.array("i", "j", "k")))).alias("gone"))


def _deduped(docs: DataFrame) -> DataFrame:
    """``d``, the whole row as a struct so that no column's name can clash, with text (after), n_lines and removed (numbers of the lines that go)."""
    gone = later_windows(docs).withColumnsRenamed({"doc_id": "of", "hash": "of_hash"})
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d")).join(gone, F.col("d.doc_id").cast("long").eqNullSafe(F.col("of")) & (F.xxhash64(F.col("d.text")) == F.col("of_hash")), "left")
    # only texts that lose lines are cut up; the generator holds their lines once
    whole = F.col("d.text")
    staged = found.select("d", "gone", F.explode(F.array(F.when(F.col("gone").isNotNull() & whole.isNotNull(), _lines(whole)))).alias("cut"))
    none = F.array().cast("array<int>")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("cut") - 1), "gone"), lambda i: F.get("cut", i))
    return staged.select(
        "d",
        F.when(F.col("cut").isNull(), whole).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.coalesce(F.length(whole) - F.length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).alias("n_lines"),
        F.when(F.col("cut").isNull(), none).otherwise(F.coalesce("gone", none)).alias("removed"),
    )


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the text freed of later occurrences; n_chars, where there is one, follows the text."""
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType)
    return _deduped(docs).select(*(new[c].alias(c) if c in new else F.col(f"d.`{c}`").alias(c) for c in docs.columns))


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, removed (line numbers, comma-joined) and the text that stays."""
    return _deduped(docs.select("doc_id", "text")).select(
        F.col("d.doc_id").cast("long").alias("doc_id"),
        F.col("n_lines").cast("long").alias("n_lines"),
        F.size("removed").cast("long").alias("n_removed"),
        F.array_join(F.array_sort("removed"), ",").alias("removed"),
        "text",
    )
