"""Graph operators on edge tables: expansion, degree, components, bounded closure, schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import placed, remove, written

#: Relations that tie a person to a document.
PERSON_RELATIONS = ("MENTIONS", "SENT", "SENT_BY", "AUTHORED", "AUTHORED_BY", "TO", "ORGANIZED_BY", "ATTENDED_BY", "CREATED_BY")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: (label, id, rel, other_label, other_id)."""
    forward = edges.select(F.col("src_label").alias("label"), F.col("src_id").alias("id"), "rel", F.col("dst_label").alias("other_label"), F.col("dst_id").alias("other_id"))
    back = edges.select(F.col("dst_label").alias("label"), F.col("dst_id").alias("id"), "rel", F.col("src_label").alias("other_label"), F.col("src_id").alias("other_id"))
    return forward.unionByName(back)


def expand(nodes: DataFrame, edges: DataFrame, rel: str, out: bool = True) -> DataFrame:
    """Nodes with the ids at the other end of their ``rel`` edges."""
    here, there = ("src_id", "dst_id") if out else ("dst_id", "src_id")
    return nodes.join(edges.where(F.col("rel") == rel).select(F.col(here).alias("source_id"), F.col(there).alias("other_id")), "source_id")


def degrees(edges: DataFrame, skip: str = "SAME_AS") -> DataFrame:
    """Edge incidences of each node, without identity edges."""
    return both_ways(edges.where(F.col("rel") != skip)).groupBy("id").agg(F.count("*").alias("degree"))


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the least id reachable over undirected pairs.

    Large-star and small-star steps alternate on stored tables until nothing moves, in about log(size) rounds. Minima are aggregated before the shuffle.
    Only the last table outlives the loop.
    """
    spark = pairs.sparkSession
    edges, path = placed(pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    n = edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large, large_path = placed(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        new, new_path = placed(small, "small")
        # sets of equal size are equal if one lies in the other
        size, settled = new.count(), False
        if size == n:
            settled = new.join(edges, ["u", "v"], "left_anti").isEmpty()
        for done in (path, large_path):
            remove(spark, done)
        edges, path, n = new, new_path, size
        if settled:
            break
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def closure(pairs: DataFrame, never: DataFrame | None = None, hops: int = 4, a: str = "a", b: str = "b") -> DataFrame:
    """New pairs (a < b) joined by an undirected path of 2 to ``hops`` edges, neither linked nor blocked themselves. One pass, as deep as ``hops`` alone."""
    direct = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a <> b").distinct()
    steps = direct.unionByName(direct.select(F.col("b").alias("a"), F.col("a").alias("b")))
    reached = frontier = steps
    for _ in range(hops - 1):
        frontier = frontier.select("a", F.col("b").alias("m")).join(steps.select(F.col("a").alias("m"), "b"), "m").select("a", "b").where("a <> b").distinct()
        reached = reached.unionByName(frontier).distinct()
    new = reached.where("a < b").join(direct, ["a", "b"], "left_anti")
    if never is not None:
        new = new.join(never.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")), ["a", "b"], "left_anti")
    return new


def canonical(members: DataFrame, edges: DataFrame) -> DataFrame:
    """The member of each component with most edges, ties by id: (component, canonical)."""
    ranked = members.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = F.row_number().over(Window.partitionBy("component").orderBy(F.desc("degree"), "id")) == 1
    return ranked.withColumn("first", best).where("first").select("component", F.col("id").alias("canonical"))


def cluster_of(person_id: str, same_as: DataFrame) -> DataFrame:
    """Everyone that identity edges reach from a person, that person included: (source_id)."""
    spark = same_as.sparkSession
    found = spark.createDataFrame([(person_id,)], "source_id string")
    both = both_ways(same_as).select(F.col("id").alias("source_id"), F.col("other_id").alias("next"))
    n = 1
    while True:
        found = written(found.unionByName(found.join(both, "source_id").select(F.col("next").alias("source_id"))).distinct(), "cluster")
        now = found.count()
        if now == n:
            return found
        n = now


def schema_summary(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Property names of each label, and the (source, relation, target) patterns with their counts."""
    props = nodes.select("label", F.explode(F.map_keys("props")).alias("property")).groupBy("label", "property").agg(F.count("*").alias("n"))
    return props, edges.groupBy("src_label", "rel", "dst_label").agg(F.count("*").alias("n"))


def without_existing(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs without any edge in either direction."""
    linked = edges.select(F.least("src_id", "dst_id").alias("a"), F.greatest("src_id", "dst_id").alias("b"))
    return pairs.join(linked, ["a", "b"], "left_anti")


def nearby(points: DataFrame, places: DataFrame, reach: float = 0.005, key: str = "id") -> DataFrame:
    """Points with each place less than ``reach`` degrees away in both directions: cells of that size and their neighbours meet by an equi-join."""
    cell = lambda c: F.floor(F.col(c) / reach).cast("long")
    around = F.explode(F.array(*(F.lit(k) for k in (-1, 0, 1))))
    p = points.select(F.col(key).alias("point"), F.col("lat").alias("plat"), F.col("lon").alias("plon"), cell("lat").alias("y"), cell("lon").alias("x"))
    q = places.select(F.col(key).alias("place"), "lat", "lon", cell("lat").alias("y0"), cell("lon").alias("x0")).withColumn("dy", around).withColumn("dx", around)
    q = q.select("place", "lat", "lon", (F.col("y0") + F.col("dy")).alias("y"), (F.col("x0") + F.col("dx")).alias("x"))
    return p.join(q, ["y", "x"]).where((F.abs(F.col("plat") - F.col("lat")) < reach) & (F.abs(F.col("plon") - F.col("lon")) < reach)).select("point", "place")


def relational_division(holds: DataFrame, wanted: DataFrame, key: str, item: str) -> DataFrame:
    """Keys that hold every wanted item. The wanted set is counted once; keys are counted after a semi-join, before the shuffle's reduce."""
    need = wanted.select(item).distinct()
    have = holds.join(need, item).groupBy(key).agg(F.count_distinct(item).alias("have"))
    n = need.agg(F.count("*").alias("need"))
    return have.join(F.broadcast(n), F.col("have") == F.col("need")).where("need > 0").select(key)  # a single row


def unanswered(asked: DataFrame, answers: DataFrame, by: str, at: Column | str = "ts") -> DataFrame:
    """Rows without a later answer in the same group: the group's last answer is enough to know."""
    last = answers.groupBy(by).agg(F.max(at).alias("_last"))
    return asked.join(last, by, "left").where(F.col("_last").isNull() | (F.col("_last") <= F.col(at))).drop("_last")


def taken_at(images: DataFrame, places: DataFrame, digits: int = 3) -> DataFrame:
    """(image, place) of equal coordinates after rounding: an equi-join on rounded decimals."""
    cell = lambda c, name: F.round(F.col(c), digits).cast(f"decimal(9,{digits})").alias(name)
    i = images.select(F.col("id").alias("image"), cell("lat", "y"), cell("lon", "x"))
    q = places.select(F.col("id").alias("place"), cell("lat", "y"), cell("lon", "x"))
    return i.join(q, ["y", "x"]).select("image", "place").distinct()
