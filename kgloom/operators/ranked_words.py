"""Names ranked by words that are spelt alike: an exchange of neighbouring letters is one edit, and hits are scored by BM25 from stored postings.

Short words meet on patterns that stand for just their edits (see ``fulltext``), longer ones on one of five pieces, of which two edits break four at most. How many words share
a pattern depends on how words can be spelt, not on how many rows there are: words are made distinct first. At a hundred times the data the postings of a common word are the
largest group; they are joined by equality, which Spark splits where it is skewed.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .fulltext import CONFIDENCE, LONG, MOST_EDITS, SHORT, TYPE, _met_by_patterns, _met_by_pieces

# BM25's saturation and weight of length.
K1, B = 1.2, 0.75
PIECES = 5


def osa_within(a: str, b: str, most: int = MOST_EDITS) -> int:
    """Edits between two words (optimal string alignment: no part is edited twice); ``most + 1`` stands for more. Only a band about the diagonal is worked out."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before, row = [], [j if j <= most else far for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        new = [far] * (len(b) + 1)
        if i <= most:
            new[0] = i
        for j in range(max(1, i - most), min(len(b), i + most) + 1):
            y = b[j - 1]
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            new[j] = min(d, far)
        before, row = row, new
    return row[-1]


@F.pandas_udf(IntegerType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa_within(x, y) for x, y in zip(a, b)], dtype="int32")


def near_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(word, near, edits) of all words of ``right`` that are at most two edits, and fewer than either has characters, from one of ``left``."""
    short, long = (lambda df: df.where(F.length("word") <= SHORT)), (lambda df: df.where(F.length("word") >= LONG))
    pieces = _met_by_pieces(long(left), long(right), PIECES, LONG).where(F.greatest(F.length("word"), F.length("near")) > SHORT).withColumn("edits", _edits("word", "near"))
    return _met_by_patterns(short(left), short(right), True).unionByName(pieces.where(F.col("edits") <= MOST_EDITS))


def all_words(text: Column) -> Column:
    """Lower-case runs of letters and digits, repeats included."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


@dataclass
class Index:
    """``postings`` (word, name, times, length), ``frequencies`` (word, names) and ``totals`` (names, mean_length; one row). Stored as tables they answer any number of queries."""

    postings: DataFrame
    frequencies: DataFrame
    totals: DataFrame


def build(entities: DataFrame, name_col: str = "name") -> Index:
    """Of distinct names that have a word; null names and names of marks alone have none."""
    named = entities.select(F.col(name_col).alias("name")).where("name IS NOT NULL").distinct().withColumn("_w", all_words(F.col("name"))).where(F.size("_w") > 0)
    postings = named.select("name", F.size("_w").alias("length"), F.explode("_w").alias("word")).groupBy("word", "name", "length").agg(F.count("*").alias("times"))
    frequencies = postings.groupBy("word").agg(F.count("*").alias("names"))
    totals = named.agg(F.count("*").alias("all_names"), F.avg(F.size("_w")).alias("mean_length"))
    return Index(postings, frequencies, totals)


def candidates(asked: DataFrame, index: Index, entities: DataFrame, by: list[str], name_col: str = "name") -> DataFrame:
    """(by, name, type, confidence, score) of the entities that have a word near one of those asked for by each key, best first by ``score``, ties by name.

    A near word counts with 1 - edits / length of the shorter word. A key that hits nothing has one row without a name and score: its candidates are all entities, which are not repeated for it.
    Entities without type or confidence get the defaults; of entities that share a name each is a candidate. Keys may be null and are then one key.
    """
    keys = asked.select(*by).distinct()
    wanted = asked.select(*by, F.explode(all_words(F.col(name_col))).alias("word")).distinct()
    weight = 1 - F.col("edits") / F.least(F.length("word"), F.length("near"))
    near = near_words(wanted, index.frequencies).withColumn("weight", weight)
    rated = near.join(index.frequencies.withColumnRenamed("word", "near"), "near").crossJoin(F.broadcast(index.totals))  # a single row
    idf = F.log(1 + (F.col("all_names") - F.col("names") + 0.5) / (F.col("names") + 0.5))
    rated = rated.select("word", "near", "mean_length", (F.col("weight") * idf).alias("worth"))
    hits = wanted.join(rated, "word").join(index.postings.withColumnRenamed("word", "near"), "near")
    full = F.col("times") * (K1 + 1) / (F.col("times") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = hits.groupBy(*by, "name").agg(F.sum(F.col("worth") * full).alias("score"))
    told = entities.select(F.col(name_col).alias("name"), F.coalesce("type", F.lit(TYPE)).alias("type"), F.coalesce("confidence", F.lit(CONFIDENCE)).alias("confidence"))
    found = scored.join(told, "name").select(*by, "name", "type", "confidence", "score")
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"h.{c}")) for c in by]
    return keys.alias("k").join(found.alias("h"), same, "left").select(*(f"k.{c}" for c in by), "name", "type", "confidence", "score")
