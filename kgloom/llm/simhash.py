"""SimHash near-duplicates, searched with vantage-point trees over Hamming distance.

*Fingerprints.* ASCII letters are lower-cased; words are runs of anything but ASCII blanks; shingles are three words joined
by a space, repeats included (fewer words: all of them; none: fingerprint zero). A bit is 1 if it is set in over half of the
shingles' XXH64 values (seed 42).

*Search.* Distinct fingerprints only. A vantage-point tree of bounded depth, built on a bounded sample, deals them to shards: at each node a
fingerprint belongs to the inside (distance to the vantage point at most the radius) or the outside. Two fingerprints within ``r``
have distances to the vantage point that differ by at most ``r`` (triangle bound), so one near the boundary is also sent as a *query*
to the other side's shard; every pair within ``r`` meets in the shard of one of both. In a shard, homes and queries go down a further tree by
the same bounds to small leaves, where distances are computed exactly. A pair is missed nowhere: the bounds only
prune branches that cannot hold a partner.

*Groups.* A shard returns a spanning forest of its links, never pairs, so a group of k fingerprints costs it k rows. Connected components
of the forests' union are found by alternating large-star and small-star steps on stored tables.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; repeated rows share a component; an empty table
gives no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, stored, utf8

SEED, WORDS, RADIUS = 42, 3, 2
#: Fingerprints of a shard when all fit into one, and the power by which the number of shards grows with them: each level of the tree makes more queries, so shards grow a little too.
SHARD, GROWTH = 60_000, 0.75
#: The least sample that a top tree is built on and what it has for each shard, queries that a shard takes in at a time, rows of a leaf, links held before they are merged.
SAMPLE, OF_SHARD, ASKING, LEAF, LINKS = 20_000, 64, 1 << 20, 512, 1 << 20


def fingerprint(raw: bytes) -> int:
    """64-bit SimHash of a text's UTF-8 bytes."""
    words = raw.lower().split()  # on bytes: ASCII letters and ASCII blanks only
    if not words:
        return 0
    shingles = list(map(b" ".join, zip(*(words[k:] for k in range(WORDS))))) if len(words) >= WORDS else [b" ".join(words)]
    counts = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for first in range(0, len(shingles), 4096):
        part = shingles[first : first + 4096]
        hashes = np.fromiter([digest(s, SEED) for s in part], dtype="<u8", count=len(part))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(shingles), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(raw.as_py()) for raw in batch.column("raw")), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("raw")).mapInArrow(_fingerprints, "doc_id long, fp long")


def distances(points: np.ndarray, other) -> np.ndarray:
    return np.bitwise_count(points ^ other)


# A top tree is an array of vantage points and one of radii by heap position: node k has 2k+1 inside and 2k+2 outside.
# A radius of PASS marks a node that the sample was too thin for: everything goes on inside.
PASS = -1


def top_tree(sample: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    vantages, radii = np.zeros((1 << depth) - 1, np.uint64), np.full((1 << depth) - 1, PASS, np.int64)
    parts = {0: sample}
    for k in range(len(radii)):
        part = parts.pop(k, sample[:0])
        if len(part) < 2:
            continue
        # of a few candidates, the one whose boundary is crossed least
        best = None
        for vantage in part[rng.integers(0, len(part), min(12, len(part)))]:
            d = distances(part, vantage)
            radius = int(np.median(d))
            inside = d <= radius
            crossing = ((d > radius - RADIUS) & inside).mean() + 0.5 * abs(inside.mean() - 0.5)
            if best is None or crossing < best[0]:
                best = (crossing, vantage, radius, inside)
        _, vantages[k], radii[k], inside = best
        parts[2 * k + 1], parts[2 * k + 2] = part[inside], part[~inside]
    return vantages, radii


def route(points: np.ndarray, tree: tuple[np.ndarray, np.ndarray], reach: int = RADIUS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the point, shard, and whether it is at home there. Queries are sent from the inside out only: the pair meets where its outer part is at home."""
    vantages, radii = tree
    index, at, home = np.arange(len(points)), np.zeros(len(points), np.int64), np.ones(len(points), bool)
    for _ in range((len(radii) + 1).bit_length() - 1):
        d, radius = distances(points[index], vantages[at]).astype(np.int64), radii[at]
        splits = radius != PASS
        inner = ~splits | (d <= radius)
        into = inner | (~home & (d - reach <= radius))
        out = splits & (~inner | (d + reach > radius))
        index, at, home = np.concatenate([index[into], index[out]]), np.concatenate([2 * at[into] + 1, 2 * at[out] + 2]), np.concatenate([(home & inner)[into], (home & ~inner)[out]])
    return index, at - len(radii), home


class Forest:
    """Links gathered as a spanning forest over positions 0 to n - 1: arrays in, merged whenever many have come together."""

    def __init__(self, n: int, most: int = LINKS):
        self.root = np.arange(n)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.held, self.most = 0, most

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        self.waiting.append((a, b))
        self.held += len(a)
        if self.held > self.most:
            self.merge()

    def merge(self) -> np.ndarray:
        if self.waiting:
            a, b = (np.concatenate(x) for x in zip(*self.waiting))
            root = self.root
            while True:
                x, y = root[a], root[b]
                differ = x != y
                if not differ.any():
                    break
                a, b, x, y = a[differ], b[differ], x[differ], y[differ]
                np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
                while True:
                    up = root[root]
                    if (up == root).all():
                        break
                    root[:] = up
            self.waiting, self.held = [], 0
        return self.root


def search(points: np.ndarray, homes: np.ndarray, forest: Forest, rng: np.random.Generator, reach: int = RADIUS, leaf: int = LEAF) -> None:
    """Links every home to each home or query within ``reach``. ``points`` are distinct; ``homes`` flags those at home."""
    stack = [(np.nonzero(homes)[0], np.nonzero(~homes)[0], 0)]
    while stack:
        inner, asking, depth = stack.pop()
        if not len(inner) or len(inner) + len(asking) < 2:
            continue
        small = len(inner) <= leaf or depth > 40
        if not small:
            d_in = None
            for vantage in points[inner[rng.integers(0, len(inner), 4)]]:
                d = distances(points[inner], vantage).astype(np.int64)
                radius = int(np.median(d))
                share = (d <= radius).mean()
                rated = (abs(share - 0.5) + ((d > radius - reach) & (d <= radius)).mean(), radius, vantage, d)
                if d_in is None or rated[0] < d_in[0]:
                    d_in = rated
            _, radius, vantage, d = d_in
            inside = d <= radius
            small = inside.all() or not inside.any()
        if small:
            everyone = np.concatenate([inner, asking])
            step = max(1, (1 << 21) // len(everyone))
            for first in range(0, len(inner), step):
                some = inner[first : first + step]
                i, j = np.nonzero(distances(points[some][:, None], points[everyone][None, :]) <= reach)
                a, b = some[i], everyone[j]
                apart = a != b
                forest.link(a[apart], b[apart])
            continue
        d_ask = distances(points[asking], vantage).astype(np.int64)
        near = inner[inside & (d + reach > radius)]
        stack.append((inner[inside], asking[d_ask - reach <= radius], depth + 1))
        stack.append((inner[~inside], np.concatenate([asking[d_ask + reach > radius], near]), depth + 1))


def _search_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition sorted by shard, homes first: links of each shard as (fingerprint, least fingerprint linked to it here).

    A shard's homes are held; its queries, which may be many times more, are held against them a bounded number at a time.
    """
    homes_held, asking, waiting, asked, shard = [], [], 0, False, None

    def links() -> pa.RecordBatch:
        at_home = np.concatenate([np.empty(0, np.int64), *homes_held])
        points = np.concatenate([at_home, *asking]).view(np.uint64)
        homes = np.arange(len(points)) < len(at_home)
        forest = Forest(len(points))
        search(points, homes, forest, np.random.default_rng(len(points)))
        root = forest.merge()
        # the root is the first position of its group: label the group by its least fingerprint instead
        least = np.full(len(points), np.iinfo(np.int64).max)
        signed = points.view(np.int64)
        np.minimum.at(least, root, signed)
        linked = np.nonzero(least[root] != signed)[0]
        return pa.RecordBatch.from_arrays([pa.array(signed[linked]), pa.array(least[root][linked])], ["a", "b"])

    for batch in batches:
        shards, prints, at_home = batch.column("shard").to_numpy(), batch.column("fp").to_numpy(), batch.column("home").to_numpy(zero_copy_only=False)
        bounds = np.concatenate([[0], np.nonzero(np.diff(shards))[0] + 1, [len(shards)]])
        for lo, hi in zip(bounds, bounds[1:]):
            if lo == hi:
                continue
            if shards[lo] != shard:
                if homes_held and (asking or not asked):
                    yield links()
                homes_held, asking, waiting, asked, shard = [], [], 0, False, shards[lo]
            points, n_homes = prints[lo:hi], int(at_home[lo:hi].sum())
            if n_homes:
                homes_held.append(points[:n_homes])
            if n_homes < hi - lo and homes_held:
                asking.append(points[n_homes:])
                waiting += hi - lo - n_homes
                if waiting >= max(ASKING, sum(map(len, homes_held))):
                    yield links()
                    asking, waiting, asked = [], 0, True
    if homes_held and (asking or not asked):
        yield links()


def linked_fingerprints(distinct: DataFrame, n: int, shard: int = SHARD) -> DataFrame:
    """Spanning links (a, b) between distinct fingerprints within ``RADIUS`` of each other. ``n`` is their number."""
    depth = max(0, int(np.ceil(GROWTH * np.log2(max(1, n) / shard))))
    sampled = distinct.orderBy(F.xxhash64("fp"), "fp").limit(max(SAMPLE, OF_SHARD << depth)).toArrow()["fp"].to_numpy()
    tree = top_tree(sampled.view(np.uint64), depth, np.random.default_rng(SEED))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy()
            index, at, home = route(points.view(np.uint64), tree)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(points[index]), pa.array(home)], ["shard", "fp", "home"])

    dealt = distinct.mapInArrow(deal, "shard long, fp long, home boolean")
    # a task for each shard, whatever the hash of its number
    return dealt.repartitionById(1 << depth, F.col("shard").cast("int")).sortWithinPartitions("shard", F.desc("home")).mapInArrow(_search_shard, "a long, b long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root, the least node connected to it, for every node of ``links`` but the roots themselves.

    Alternating large-star and small-star steps: both attach nodes to the least node that they see, first the larger neighbours, then the
    smaller ones, until every node hangs on its component's least. Minima are aggregated before the shuffle; the joins are plain equi-joins, whose
    large partitions adaptive execution splits. A component of any shape needs about log2(size) rounds.
    """
    edges = Stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    while True:
        both = edges.df.unionByName(edges.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: every neighbour above u hangs on the least that u sees
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after_large = Stored(large, "large")
        # small star: u and its smaller neighbours hang on the least of them
        low = after_large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = after_large.df.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        after = Stored(small, "small")
        changed = after.df.exceptAll(edges.df).isEmpty() is False or edges.df.count() != after.df.count()
        edges.drop()
        after_large.drop()
        edges = after
        if not changed:
            return edges.df.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the least doc_id reachable over links of at most ``RADIUS`` bits."""
    prints = stored(fingerprints(docs), "fingerprints")
    distinct = Stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    links = Stored(linked_fingerprints(distinct.df.select("fp"), distinct.df.count()), "pairs")
    root = components(links.df)
    links.drop()
    # only linked fingerprints have a root; its least document is the component's
    linked = distinct.df.join(root, distinct.df["fp"] == root["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    of_root = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    of_print = linked.select("fp", "root").join(of_root, "root").select("fp", "component_id")
    return prints.join(of_print, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component. Rows that repeat a doc_id are one document; rows without a doc_id cannot be compared by it and stay."""
    found = near_duplicates(docs.where("doc_id IS NOT NULL"))
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
