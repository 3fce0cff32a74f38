"""Fuzzy names: token-sort ratio as an Arrow function, length-aware thresholds, and lossless blocking for it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_length(a: str, b: str) -> int:
    """Longest common subsequence by bit-parallel rows: one machine operation for many columns."""
    place: dict[str, int] = {}
    for k, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << k
    row, full = (1 << len(a)) - 1, (1 << len(a)) - 1
    for c in b:
        hit = row & place.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (both lengths); two empty strings are equal."""
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs_length(a, b) / total


def token_sorted(name: Column) -> Column:
    """Lower-case tokens in order, joined by a space."""
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(name), r"\s+"), lambda t: t != "")), " ")


@F.pandas_udf(DoubleType())
def sorted_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Of names that ``token_sorted`` has prepared."""
    return pd.Series([None if x is None or y is None else ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def token_sort_ratio(a: Column, b: Column) -> Column:
    return sorted_ratio(token_sorted(a), token_sorted(b))


def threshold(name: Column) -> Column:
    """Short names need more: under 4 characters 100, under 6 95, else 88."""
    length = F.length(F.trim(name))
    return F.when(length < 4, 100.0).when(length < 6, 95.0).otherwise(88.0)


def most_edits(n: Column, floor: float) -> Column:
    """The most insertions and deletions between a name of ``n`` characters and any other whose ratio reaches ``floor``: the other has up to n (200 - floor) / floor."""
    return F.floor(n * ((200.0 - 2.0 * floor) / floor) + 1e-9)


def _marks(keys: DataFrame, size: int, kind: str) -> DataFrame:
    """(key, tag) of each run of ``size`` characters; the second "ab" of a name is another tag than the first, so that common tags count as multisets do."""
    runs = F.transform(F.sequence(F.lit(1), F.col("n") - size + 1), lambda k: F.substring(F.col("key"), k, size))
    spread = keys.where(F.col("n") >= size).select("key", F.posexplode(runs).alias("pos", "c"))
    nth = F.row_number().over(Window.partitionBy("key", "c").orderBy("pos"))
    return spread.select("key", F.concat(F.lit(kind), F.col("c"), F.lit("#"), nth.cast("string")).alias("tag"))


def _rarest(tags: DataFrame, keys: DataFrame, most: Column) -> DataFrame:
    """(tag, key, id, name, n): the ``most`` rarest tags of each key, in one order for all."""
    rare = F.row_number().over(Window.partitionBy("key").orderBy("f", "tag"))
    ranked = tags.join(tags.groupBy("tag").agg(F.count("*").alias("f")), "tag").withColumn("r", rare)
    return ranked.join(keys, "key").where(F.col("r") <= most).select("tag", "key", "id", "name", "n")


def candidates(keys: DataFrame, floor: float, by_length: bool = True) -> DataFrame:
    """Pairs of prepared names (key, id, name, n) that can reach their floor: id_a < id_b, told apart by a rare common tag, their lengths and their edits.

    An insertion or deletion spoils at most q runs of q characters, so names within e edits share all but q e of the longer one's, and meet among the q e + 1 rarest runs
    of each (q is 3 for floors from 91, 2 from 81). Where a name, or one that it may be compared with, is too short for that (q e + 1 runs are more than it has), single
    characters are used: a common subsequence is no longer than the overlap of the multisets. Both rules lose nothing. Levenshtein's distance is never over insertions
    plus deletions, so it rules out without Python, and stops early.
    """
    growth = (200.0 - 2.0 * floor) / floor
    size = 3 if floor >= 91 else 2
    useful = size * growth < 1
    # names shorter than this may have too few runs of characters; longer ones never do
    long_enough = size / (1 - size * growth) + 1 if useful else float("inf")
    shortest_partner = F.col("n") * (floor / (200.0 - floor))
    single = keys.where(shortest_partner < long_enough) if useful else keys
    need = F.ceil(F.lit(floor / (200.0 - floor)) * F.col("n") - 1e-9)
    prefix = _rarest(_marks(single, 1, "1:"), keys, F.col("n") - need + 1)
    if useful:
        runs = keys.where(F.col("n") >= long_enough)
        prefix = prefix.unionByName(_rarest(_marks(runs, size, f"{size}:"), keys, size * most_edits(F.col("n"), floor) + 1))
    a, b = (prefix.select("tag", *(F.col(c).alias(f"{c}_{s}") for c in ("key", "id", "name", "n"))) for s in "ab")
    enough = F.greatest(F.lit(floor), threshold(F.col("name_a")), threshold(F.col("name_b"))) if by_length else F.lit(floor)
    both = F.col("n_a") + F.col("n_b")
    in_reach = (F.least("n_a", "n_b") * 200.0 >= both * enough - 1e-9) & (F.col("id_a") < F.col("id_b"))
    near = F.call_function("levenshtein", F.col("key_a"), F.col("key_b"), F.floor(both * (1 - enough / 100.0) + 1e-9).cast("int")) >= 0
    return a.join(b, "tag").where(in_reach).where(near).drop("tag").withColumn("enough", enough).dropDuplicates(["key_a", "key_b"])


def similar_pairs(names: DataFrame, floor: float, id_col: str = "id", name_col: str = "name", by_length: bool = True) -> DataFrame:
    """Pairs a < b of rows whose ratio reaches both the floor and, ``by_length``, the threshold of each name: (a, b, name_a, name_b, score).

    Distinct prepared names are compared; further rows of one name are linked to its first, so a name that many rows share costs a row each. Blocking loses nothing
    (``candidates``); null and empty names have no pairs.
    """
    named = names.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"), token_sorted(F.col(name_col)).alias("key")).where("key <> ''")
    keys = named.groupBy("key").agg(F.min("id").alias("id"), F.min_by("name", "id").alias("name")).withColumn("n", F.length("key"))
    scored = candidates(keys, floor, by_length).withColumn("score", sorted_ratio("key_a", "key_b"))
    between = scored.where(F.col("score") >= F.col("enough")).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "name_a", "name_b", "score")
    same = named.alias("x").join(keys.alias("y"), "key").where("x.id > y.id").select(F.col("y.id").alias("a"), F.col("x.id").alias("b"), F.col("y.name").alias("name_a"), F.col("x.name").alias("name_b"), F.lit(100.0).alias("score"))
    return between.unionByName(same)
