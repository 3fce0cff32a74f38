"""Document fingerprints by consistent weighted sampling over word counts.

A text's terms are its lower-case words, weighted by how often they occur. For each of ``SAMPLES`` samples every term draws
r, c ~ Gamma(2, 1) and b ~ U(0, 1) from a generator keyed by the term and the sample alone. With weight S, t = floor(ln S / r + b), ln y = r (t - b) and
ln a = ln c - ln y - r; the term of least a, together with its t, is the sample. Two texts agree in a sample with the probability of their
generalised Jaccard similarity, sum of minima over sum of maxima of weights; the share of equal samples estimates it.

The edited text of a document ends with the beginning of the next document by id, so rows are dealt in order of doc_id to
ranges, one text shuffle in all; each range also gets the first row of the next. Inside a range rows stream by. An id that many rows share is cut by the
hash of their texts, and equal rows that alone fill ranges are counted before the shuffle and spread again after it.

Defined cases: null is the empty text; texts without words share one fingerprint, with likeness 1 to each other; a lone document is its own
next; rows that repeat a doc_id follow each other by their texts' hash; rows without a doc_id come first; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import reached
from .common import shuffle_partitions

SAMPLES, SEED = 64, 17
#: Terms whose draws a worker keeps, the commonest words soon among them, and so many met last: 64 * 4 floats each.
KEPT_TERMS, LATE_TERMS, SLICE = 1 << 15, 1 << 14, 1 << 12
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
COUNTED = f"{SCHEMA}, copies long"
LEAST_HASH, MOST_COPIES = -(2**62), 1 << 12
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _uniform(keys: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """A uniform number in (0, 1) for each key and counter, by the splitmix64 finaliser."""
    x = keys[:, None] + counters[None, :] * _MIX[0]
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    x ^= x >> np.uint64(31)
    return ((x >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2**-24)


def draws(keys: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r, ln c and b of each term and sample, from the terms' 64-bit keys."""
    u = _uniform(keys, np.arange(1, 5 * samples + 1, dtype=np.uint64)).reshape(len(keys), 5, samples)
    return -np.log(u[:, 0] * u[:, 1]), np.log(-np.log(u[:, 2] * u[:, 3])), u[:, 4]


def term_key(term: str) -> int:
    return xxhash.xxh64_intdigest(term.encode(), SEED)


class Sampler:
    """Signatures of texts. Draws of the first ``kept`` terms met and of those met last are remembered; others are drawn again, so memory is bounded."""

    def __init__(self, kept: int = KEPT_TERMS, late: int = LATE_TERMS):
        self.kept, self.late = kept, max(late, SLICE)
        self.place: dict[str, int] = {}
        self.late_terms: list[str] = []
        rows = kept + self.late
        self.keys = np.zeros(rows, np.uint64)
        self.r, self.log_c, self.b, self.log_a = (np.zeros((rows, SAMPLES), np.float32) for _ in range(4))

    def _forget_late(self) -> None:
        for term in self.late_terms:
            del self.place[term]
        self.late_terms = []

    def _rows(self, terms: list[str]) -> np.ndarray:
        """Where the draws of at most ``SLICE`` terms are."""
        new = [t for t in terms if t not in self.place]
        if new and len(self.place) - len(self.late_terms) + len(new) > self.kept and len(self.late_terms) + len(new) > self.late:
            self._forget_late()
            new = [t for t in terms if t not in self.place]
        if new:
            stay = len(self.place) - len(self.late_terms)
            n = min(len(new), self.kept - stay)
            at = np.concatenate([np.arange(stay, stay + n), np.arange(self.kept + len(self.late_terms), self.kept + len(self.late_terms) + len(new) - n)])
            self.keys[at] = [term_key(t) for t in new]
            r, log_c, b = draws(self.keys[at])
            self.r[at], self.log_c[at], self.b[at], self.log_a[at] = r, log_c, b, log_c + r * b - r
            self.place.update(zip(new, at.tolist()))
            self.late_terms += new[n:]
        return np.fromiter(map(self.place.__getitem__, terms), np.int64, len(terms))

    def signature(self, text: str) -> np.ndarray:
        """A 16-bit digest of each sample; zeros for a text without words."""
        counts = Counter(text.lower().split())
        if not counts:
            return np.zeros(SAMPLES, np.uint16)
        terms, times, parts = list(counts), np.fromiter(counts.values(), np.int64, len(counts)), []
        for first in range(0, len(terms), SLICE):
            at = self._rows(terms[first : first + SLICE])
            parts.append(self._best(self.keys[at], times[first : first + SLICE], self.log_a[at], lambda many, at=at: (self.r[at[many]], self.log_c[at[many]], self.b[at[many]])))
        least = np.stack([p[0] for p in parts])
        one = least.argmin(axis=0), np.arange(SAMPLES)
        return _digest(np.stack([p[1] for p in parts])[one], np.stack([p[2] for p in parts])[one])

    @staticmethod
    def _best(keys: np.ndarray, n: np.ndarray, log_a: np.ndarray, of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each sample: the least ln a, its term's key and its t. For a term met once t is 0 and ln a is ready; the others are worked out."""
        many = np.nonzero(n > 1)[0]
        steps = None
        if len(many):
            r, log_c, b = of(many)
            steps = np.floor(np.log(n[many])[:, None].astype(np.float32) / r + b)
            log_a[many] = log_c - r * (steps - b) - r
        at = log_a.argmin(axis=0)
        t = np.zeros(SAMPLES, np.int64)
        if steps is not None:
            row = np.full(len(keys), -1)
            row[many] = np.arange(len(many))
            here = row[at]
            t = np.where(here >= 0, steps[np.maximum(here, 0), np.arange(SAMPLES)], 0).astype(np.int64)
        return log_a[at, np.arange(SAMPLES)], keys[at], t


def _digest(keys: np.ndarray, t: np.ndarray) -> np.ndarray:
    x = keys ^ (t.astype(np.uint64) * _MIX[0])
    x = (x ^ (x >> np.uint64(32))) * _MIX[1]
    short = (x >> np.uint64(48)).astype(np.uint16)
    return np.maximum(short, 1)  # zero is kept for texts without words


def to_text(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(one: np.ndarray, other: np.ndarray) -> float:
    """Share of equal samples: an estimate of the generalised Jaccard similarity."""
    return float((one == other).mean())


def edited_text(text: str, following: str) -> str:
    """``text`` with its last quarter, rounded down, replaced by as much of the beginning of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def text_hash():
    """53 bits, which quantiles keep exactly: they reckon in doubles."""
    return F.shiftright(F.xxhash64(F.coalesce("text", F.lit(""))), 11)


def _bounds(docs: DataFrame, parts: int) -> tuple[list[tuple], list[tuple]]:
    """Bounds (doc_id, hash) of about ``parts`` ranges of rows, and the keys of which one alone fills ranges.

    Quantiles of doc_id cut the table. An id that several of them name, or none where many rows have none, is cut again by quantiles of its texts' hashes.
    What several of those name is one text over and over. All lists hold fewer than ``parts`` entries.
    """
    if parts == 1:
        return [], []
    shares = [k / parts for k in range(1, parts)]
    ids = Counter(int(b) for b in docs.approxQuantile("doc_id", shares, 0.2 / parts))
    seen = docs.agg(F.count("*").alias("rows"), F.count("doc_id").alias("named")).first()
    hot = {i: n for i, n in ids.items() if n > 1}
    if (nameless := round(parts * (seen["rows"] - seen["named"]) / max(seen["rows"], 1))) > 1:
        hot[None] = nameless
    bounds, heavy = {(i, LEAST_HASH) for i in ids}, []
    if hot:
        wanted = F.col("doc_id").isin([i for i in hot if i is not None])
        cuts = docs.where(F.coalesce(wanted, F.lit(None in hot))).groupBy("doc_id").agg(F.percentile_approx("hash", shares, max(10_000, 10 * parts)).alias("cuts"))
        for row in cuts.collect():
            n = hot[row["doc_id"]]
            found = Counter(row["cuts"][math.ceil(k * parts / n) - 1] for k in range(1, n))
            bounds |= {(row["doc_id"], h) for h in found}
            heavy += [(row["doc_id"], h) for h, times in found.items() if times > 1]
    return sorted(bounds, key=lambda b: (b[0] is not None, b[0] or 0, b[1])), heavy


def _range_of(bounds: list[tuple]):
    """The number of a row's range. Structs are compared field by field, null before any id."""
    if not bounds:
        return F.lit(0)
    listed = ", ".join(f"named_struct('id', {'cast(null AS bigint)' if i is None else f'{i}L'}, 'hash', {h}L)" for i, h in bounds)
    return reached(F.expr(f"array({listed})"), F.struct(F.col("doc_id").alias("id"), "hash"), len(bounds))


def _counted(docs: DataFrame, heavy: list[tuple]) -> DataFrame:
    """Rows with ``copies``: equal rows of heavy keys are one, counted before the shuffle; all others stay as they are."""
    if not heavy:
        return docs.withColumn("copies", F.lit(1).cast("long"))
    keys = docs.sparkSession.createDataFrame([(*k, True) for k in heavy], "id long, of_hash long, heavy boolean")  # fewer than ranges
    marked = docs.join(F.broadcast(keys), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("of_hash")), "left")
    many = marked.where("heavy").groupBy("doc_id", "text", "hash").agg(F.count("*").alias("copies"))
    return marked.where("heavy IS NULL").select("doc_id", "text", "hash", F.lit(1).cast("long").alias("copies")).unionByName(many)


def _circle(rows: DataFrame) -> list[tuple]:
    """(doc_id and hash of a range's first row, the range before it): a row for each range."""
    firsts = sorted((r["range"], *r["first"]) for r in rows.groupBy("range").agg(F.min(F.struct("doc_id", "hash")).alias("first")).collect())
    return [(doc_id, h, firsts[k - 1][0]) for k, (_, doc_id, h) in enumerate(firsts)]


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of whole ranges, in order; the last of each range is marked ``ahead`` and only serves the row before it."""
    sampler, names = Sampler(), [c.split()[0] for c in COUNTED.split(", ")]
    before = None
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        out.clear()
        return batch

    def compared(doc_id: int, text: str, own: np.ndarray, following: str, after: np.ndarray) -> tuple:
        edited = edited_text(text, following)
        changed = sampler.signature(edited) if edited != text else own
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), to_text(own), to_text(changed), likeness(own, changed), likeness(own, after)

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("range", "ahead", "doc_id", "copies")]
        for where, ahead, doc_id, copies, text in zip(*columns, batch.column("text")):
            text = text.as_py() or ""
            if before is not None and before[0] == where:
                signature = sampler.signature(text)
                out.append((*compared(*before[1:], text, signature), 1))
            elif not ahead:
                signature = sampler.signature(text)
            if not ahead and copies > 1:  # each but the last is followed by its equal
                own = compared(doc_id, text, signature, text, signature)
                for done in range(0, copies - 1, MOST_COPIES):
                    out.append((*own, min(MOST_COPIES, copies - 1 - done)))
                    if len(out) >= 512:
                        yield flush()
            before = None if ahead else (where, doc_id, text, signature)
            if len(out) >= 512:
                yield flush()
    if out:
        yield flush()


def fingerprint_with_edit(docs: DataFrame) -> DataFrame:
    """The columns of ``SCHEMA`` for every document: its fingerprint, that of its edited text, and likenesses."""
    spark, parts = docs.sparkSession, shuffle_partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("hash"))
    bounds, heavy = _bounds(docs, parts)
    ranged = docs.withColumn("range", _range_of(bounds))
    ahead = spark.createDataFrame(_circle(ranged), "first long, first_hash long, before int")  # a row for each range
    at_first = F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("hash") == F.col("first_hash"))
    here = _counted(docs, heavy).withColumn("range", _range_of(bounds)).join(F.broadcast(ahead), at_first, "left")
    copies = F.array_compact(F.array(F.struct(F.col("range"), F.lit(False).alias("ahead")), F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("range"), F.lit(True).alias("ahead")))))
    dealt = here.select("doc_id", "text", "hash", "copies", F.explode(copies).alias("to")).select("to.range", "to.ahead", "doc_id", "text", "hash", "copies")
    # one look-ahead row closes a range: of rows that repeat an id the first by hash
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("range")).sortWithinPartitions("range", "ahead", "doc_id", "hash", F.coalesce("text", F.lit("")))
    found = ordered.mapInArrow(_stream, COUNTED)
    if not heavy:
        return found.drop("copies")
    spread = found.repartition(parts)
    return spread.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copy", "copies")
