"""Mixing sources to target weights by the cube method.

Sources, in order of code point with null last, weigh 1, 2, 3, 1, 2, 3 and so on, and share all words. A source gives at most ``MOST`` times
its words; what it cannot give is shared again by weight. A document of a source whose target is r times its words is taken floor(r) times, and once more with
probability r - floor(r). Those extra copies are drawn by balanced sampling: probabilities move at random within the null space of the
constraints (number of documents, number of words) until they reach 0 or 1, so both totals are kept exactly.

The flight runs in groups of about ``GROUP`` documents of a source, dealt by an id hash, so that one source may hold any share of rows. Each group leaves at most
two fractional documents or so, its smallest, as it settles documents by falling size. These meet in new groups, level by level, until a source has one group; its last few
documents are rounded so that the words miss the target least (the landing).

Defined cases: a null text has size 0 and its row is kept with taken 0; a null source is a source of its own; a source without words has target 0;
repeated rows are documents of their own, numbered so that many of them share no group; reruns agree, as every draw is keyed by ids and groups; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import functools
import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Stored, shuffle_partitions

WEIGHTS, MOST, GROUP, SEED = (1, 2, 3), 3, 1024, 41
EPS = 1e-9
ITEMS = "doc_id long, row long, again long, source string, size long, source_size long, target double, whole int, p double"


def size_in_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, *order: Column, name: str) -> DataFrame:
    """``df`` with its rows' ranks from 0, without gathering them: range partitions, ranked inside, and an offset for each."""
    spark = df.sparkSession
    cut = Stored(df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("part", F.spark_partition_id()), "ranked")
    counts = sorted((r["part"], r["count"]) for r in cut.df.groupBy("part").count().collect())  # a row for each partition
    starts = spark.createDataFrame([(part, sum(n for _, n in counts[:k])) for k, (part, _) in enumerate(counts)], "part int, first long")
    from pyspark.sql import Window

    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return cut.df.withColumn(name, inside - 1).join(F.broadcast(starts), "part").withColumn(name, F.col(name) + F.col("first")).drop("part", "first")


def numbered_repeats(df: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with ``again``: 0 for a row whose keys no other row has, else a number that its equals don't have. A hash of keys and number then spreads a group of any size over tasks."""
    repeats = Stored(df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*(F.col(k).alias(f"_{k}") for k in keys)), "repeats").df
    if repeats.isEmpty():
        return df.withColumn("again", F.lit(0).cast("long"))
    equal = functools.reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys))
    once = df.join(repeats, equal, "left_anti").withColumn("again", F.lit(0).cast("long"))
    several = ranked(df.join(repeats, equal, "left_semi").withColumn("_salt", F.rand(SEED)), *map(F.col, keys), F.col("_salt"), name="again")
    return once.unionByName(several.drop("_salt").withColumn("again", F.col("again").cast("long") + 1))


def source_targets(sized: DataFrame) -> DataFrame:
    """source, n, source_size and target. Shares are raised together until the sources under their limit hold the rest: one small aggregate a round."""
    totals = sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("source_size"))
    placed = ranked(totals, F.col("source").asc_nulls_last(), name="place")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("place") % len(WEIGHTS) + 1).cast("int")).cast("double")
    sources = Stored(placed.withColumn("weight", weight).drop("place"), "sources").df
    limit = F.col("source_size") * F.lit(float(MOST))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = limit <= F.lit(level) * F.col("weight")
        taken, open_weight = sources.agg(F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("weight")))).first()
        if not open_weight:
            break
        raised = (total - (taken or 0.0)) / open_weight
        if raised <= level * (1 + 1e-12):
            break
        level = raised
    return sources.select("source", "n", "source_size", F.least(limit, F.lit(level) * F.col("weight")).alias("target"))


def flight(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Probabilities moved to 0 or 1, but for about two, keeping their sum and their sum weighted by ``size``.

    Unit after unit, in the order given, is settled: the direction is the unit's own axis projected on the null space of both constraints over
    all units still open, so the others move little. Taken by falling size, the smallest documents are the ones left.
    """
    p, x = p.astype(float).copy(), size.astype(float)
    p[p <= EPS], p[p >= 1 - EPS] = 0.0, 1.0
    open_ = np.nonzero((p > 0) & (p < 1))[0]
    for k in open_.copy():
        while 0 < p[k] < 1 and len(open_) > 2:
            q, z = p[open_], x[open_] - x[open_].mean()
            u, spread = np.full(len(open_), -1.0 / len(open_)), float(z @ z)
            at = int(np.searchsorted(open_, k))
            if spread > 0:
                u -= z[at] / spread * z
            u[at] += 1
            u[np.abs(u) < 1e-12] = 0
            rising, falling = u > 0, u < 0
            if not rising.any() or not falling.any():
                break
            up = min(((1 - q[rising]) / u[rising]).min(), (q[falling] / -u[falling]).min())
            down = min((q[rising] / u[rising]).min(), ((1 - q[falling]) / -u[falling]).min())
            q = q + (up if rng.random() * (up + down) < down else -down) * u
            q[q <= EPS], q[q >= 1 - EPS] = 0.0, 1.0
            p[open_] = q
            open_ = open_[(q > 0) & (q < 1)]
    return p


def landing(size: np.ndarray, p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The rounding of the few probabilities left that misses the words least, then the documents; ties by chance."""
    open_ = np.nonzero((p > EPS) & (p < 1 - EPS))[0]
    best = min(itertools.product((0.0, 1.0), repeat=len(open_)), key=lambda s: (abs(float(((np.array(s) - p[open_]) * size[open_]).sum())) if len(s) else 0.0, abs(float((np.array(s) - p[open_]).sum())) if len(s) else 0.0, rng.random()))
    out = p.copy()
    out[open_] = best
    return out


def _fly(level: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "tie", "doc_id", "row", "again"], ascending=[False, True, True, True, True], kind="stable")
        key = f"{SEED}/{level}/{group['source'].iloc[0]}/{group['part'].iloc[0]}"
        rng = np.random.default_rng(xxhash.xxh64_intdigest(key.encode()))
        size, p = group["size"].to_numpy(), flight(group["size"].to_numpy(), group["p"].to_numpy(), rng)
        group["p"] = landing(size, p, rng) if group["parts"].iloc[0] == 1 else p
        return group[[c.split()[0] for c in ITEMS.split(", ")]]

    return run


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies (how often the document is taken) for every row of ``docs``."""
    sized = Stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_in_words().alias("size")), "sized").df
    out = _drawn(sized.withColumn("row", F.lit(0).cast("long")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def _drawn(sized: DataFrame) -> DataFrame:
    """``sized`` (doc_id, row, source, size) with source_size, target and copies."""
    sized = numbered_repeats(sized, ["doc_id", "row", "source", "size"])
    targets = source_targets(sized).withColumnRenamed("source", "of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + EPS).cast("int")
    rest = F.when(ratio - whole > EPS, ratio - whole).otherwise(0.0)
    open_ = sized.join(targets, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "row", "again", "source", "size", "source_size", "target", whole.alias("whole"), rest.alias("p"))
    level, settled = 0, []
    while True:
        counts = open_.groupBy("source").agg(F.count("*").alias("n")).select(F.col("source").alias("of"), F.ceil(F.col("n") / GROUP).cast("long").alias("parts"))
        dealt = (
            open_.join(counts, F.col("source").eqNullSafe(F.col("of")))
            .withColumn("tie", F.xxhash64("doc_id", F.lit(SEED)))
            .withColumn("part", F.pmod(F.xxhash64("doc_id", "row", "again", F.lit(SEED + 1 + level)), F.col("parts")))
            .drop("of")
        )
        flown = Stored(dealt.groupBy("source", "part").applyInPandas(_fly(level), ITEMS), f"flight{level}").df
        fractional = (F.col("p") > 0) & (F.col("p") < 1)
        settled.append(flown.where(~fractional))
        open_, level = flown.where(fractional), level + 1
        if open_.isEmpty():
            break
    done = settled[0]
    for more in settled[1:]:
        done = done.unionByName(more)
    return done.select("doc_id", "row", "size", "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies"))


def mixed_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with each row as often as the mix takes it: rows not taken go, rows taken twice occur twice."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    doc_id, row = F.col("doc_id").cast("long"), F.xxhash64(*columns, *(c.isNull() for c in columns))
    sized = Stored(docs.select(doc_id.alias("doc_id"), row.alias("row"), F.col("source").cast("string").alias("source"), size_in_words().alias("size")), "sized").df
    # equal rows can't be told apart: together they are taken as often as all of them are
    taken = Stored(_drawn(sized).groupBy(F.col("doc_id").alias("id"), F.col("row").alias("key")).agg(F.sum("copies").alias("copies"), F.count("*").alias("n")), "taken").df
    # the whole row is one struct, so no column's name can clash
    whole = docs.select(F.struct(*columns).alias("d"), row.alias("row"))
    joined = lambda some: whole.join(some, F.col("d.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("row") == F.col("key"))).drop("row")
    repeated = lambda df, times: df.select("d", F.explode(F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))).otherwise(F.array().cast("array<int>"))).alias("time")).select("d.*")
    out = repeated(joined(taken.where("n = 1")), F.col("copies"))
    if taken.where("n > 1").isEmpty():
        return out
    # n equal rows have n ranks in a row: each gets floor(copies / n), and copies mod n of them one more. The salt spreads a large group over tasks
    several = ranked(joined(taken.where("n > 1")).withColumn("salt", F.rand(SEED)), F.col("id"), F.col("key"), F.col("salt"), name="place")
    one_more = (F.col("place") % F.col("n") < F.col("copies") % F.col("n")).cast("int")
    return out.unionByName(repeated(several, F.floor(F.col("copies") / F.col("n")) + one_more))
