"""Component labels of identity pairs kept as tables, batch by batch: added pairs merge components by their labels, removed ones re-solve their own components.

A label is the least id of its component, as in ``operators.graph.components``. Membership is kept by id and by component and pairs from either end, all in buckets, so a batch reads
and writes the buckets of what it touches. Pairs of a component are not listed: two ids are the same where their labels are equal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, writers
from ..tables import staged
from .buckets import BucketStore

SCHEMAS = {"labels": "id string, component string", "members": "component string, id string", "pairs": "a string, b string", "blocked": "a string, b string"}
KEYS = {"labels": "id", "members": "component", "pairs": "a", "blocked": "a"}


def _both(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs from either end, once; without those of one id and those that lack an end."""
    forward = pairs.select(F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).where("a <> b")
    return forward.unionByName(forward.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


class Labels:
    """Every id that was ever in a pair has one label, also when all its pairs are gone: then its own."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64):
        self.store = BucketStore(spark, folder, SCHEMAS, KEYS, buckets)

    def table(self) -> DataFrame:
        return self.store.read("labels")

    def _near(self, name: str, rows: DataFrame, key: str) -> tuple[DataFrame, set[int]]:
        """The buckets of a table that the keys of ``rows`` fall into."""
        buckets = self.store.touched(rows, key)
        return self.store.read(name, buckets), buckets

    def _relabelled(self, changed: DataFrame, left: DataFrame) -> dict:
        """What to write where ``changed`` (id, component) are the new labels and ``left`` (component) the labels given up."""
        labels, by_id = self._near("labels", changed, "id")
        given_up, joined = self.store.touched(left, "component"), self.store.touched(changed, "component")
        members = writers.drop_rows(self.store.read("members", given_up | joined), left, ["component"])
        return {"labels": (writers.upsert(labels, changed, ["id"]), by_id), "members": (members.unionByName(changed), given_up | joined)}

    def add(self, pairs: DataFrame, a: str = "a", b: str = "b") -> None:
        """Adds pairs that are neither there nor blocked. Components meet by their labels, so the loop that joins them is as large as the batch."""
        with staged(self.store.spark) as put:
            both = put(_both(pairs, a, b), "both")
            there, near = self._near("pairs", both, "a")
            fresh = put(both.join(there, ["a", "b"], "left_anti").join(self.store.read("blocked", near), ["a", "b"], "left_anti"), "fresh")
            ends = fresh.select(F.col("a").alias("id")).distinct()
            labels, near = self._near("labels", ends, "id")
            if not near:
                return
            known = put(ends.join(labels, "id", "left").select("id", F.coalesce("component", "id").alias("component"), F.col("component").isNull().alias("new")), "known")
            at = lambda end: known.select(F.col("id").alias(end), F.col("component").alias(f"{end}_at"))
            # an id that is new is a component of its own until now
            moved = put(graph.components(fresh.join(at("a"), "a").join(at("b"), "b"), "a_at", "b_at").select(F.col("id").alias("component"), F.col("component").alias("to")), "moved")
            left = moved.where("component <> to").select("component")
            members, _ = self._near("members", left, "component")
            # members of labels that stay are not rewritten
            old = members.join(moved.where("component <> to"), "component").select("id", F.col("to").alias("component"))
            new = known.where("new").join(moved, "component").select("id", F.col("to").alias("component"))
            changed = put(old.unionByName(new), "changed")
            there, near = self._near("pairs", fresh, "a")
            self.store.commit(self._relabelled(changed, left) | {"pairs": (there.unionByName(fresh), near)})

    def remove(self, pairs: DataFrame, a: str = "a", b: str = "b", block: bool = False) -> None:
        """Takes pairs away; ``block`` also keeps them from being added again. Only components that lose a pair are solved anew, from their remaining pairs."""
        with staged(self.store.spark) as put:
            both = put(_both(pairs, a, b), "both")
            there, near = self._near("pairs", both, "a")
            if not near:
                return
            lost = put(there.join(both, ["a", "b"], "left_semi"), "lost")
            replaced = {"pairs": (there.join(both, ["a", "b"], "left_anti"), near)}
            if block:
                replaced["blocked"] = (self.store.read("blocked", near).unionByName(both).distinct(), near)
            ends = lost.select(F.col("a").alias("id")).distinct()
            labels, _ = self._near("labels", ends, "id")
            split = put(labels.join(ends, "id", "left_semi").select("component").distinct(), "split")
            members, _ = self._near("members", split, "component")
            members = put(members.join(split, "component", "left_semi"), "members")
            theirs, _ = self._near("pairs", members, "id")
            rest = theirs.join(members.select(F.col("id").alias("a")), "a", "left_semi").join(both, ["a", "b"], "left_anti")
            solved = graph.components(rest).withColumnRenamed("component", "to")
            changed = put(members.select("id").join(solved, "id", "left").select("id", F.coalesce("to", "id").alias("component")), "changed")
            self.store.commit(self._relabelled(changed, split) | replaced)
