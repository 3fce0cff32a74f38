"""Removal of repeated passages by relative Lempel-Ziv parsing.

A document is parsed against the text that comes before it: at each word the parser looks for the phrase of ``PHRASE`` words that begins there in the index of reference blocks, and where
one is found, the factor is made as long as text and source go on alike. At a factor's end the parse does not jump: the phrases that straddle the border are looked up as well,
so a phrase that only lies across two factors is a factor of its own. All factors have ``PHRASE`` words or more; the words they cover go.

The index. The words of the whole table, by (doc_id, hash of the text), have places that rise. A reference block holds the phrases of one range of phrase hashes, each once with its first
place, so a passage that a third of all documents share is indexed once. A phrase's first place is made in each task before anything is shuffled. Every document meets every block by
hash; nothing is compared within a group.

Only phrases that may occur twice are indexed. Each phrase is stood for by the least of the hashes of its ``PHRASE - ANCHOR + 1`` runs of ``ANCHOR`` words, one in about six of all runs; equal phrases have
the same one, so a phrase whose run occurs once in the table cannot repeat. That leaves nothing out and saves most of the index.

A document whose whole text (by two hashes of 64 bits) an earlier one has is a single factor, and is not indexed.

Defined cases: a null text has no words; a text of fewer than ``PHRASE`` words loses none; rows that repeat both doc_id and text count as one document and lose the same words; rows of one doc_id, or of none, with
different texts are documents of their own, in order of a hash of the text, those without an id first; a phrase may overlap its own source (a word repeated many times stays once as a phrase);
an empty table gives no rows; columns of ``docs`` other than doc_id and text pass through ``dedup_passages`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Stored, release_shuffles, shuffle_partitions

PHRASE, ANCHOR = 20, 10
#: Odd multipliers of two independent polynomial hashes, and the factors of a 64-bit mixer.
_BASES = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MIX = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
RUNS = "doc_id long, hash long, other long, n_words long, runs array<long>, at array<int>"
PHRASES = "h long, g int, base long, start int"
FACTORS = "base long, start int, length int, source long"
SPAN = "array<struct<start:int,length:int>>"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return pd.util.hash_array(np.array(words, dtype=object), categorize=False) if words else np.zeros(0, np.uint64)


def run_hashes(hashes: np.ndarray, size: int, base: int) -> np.ndarray:
    """A polynomial hash of each run of ``size`` words, put together from runs whose lengths are powers of two."""
    out, done, part, length, power = None, 0, hashes, 1, base
    while length <= size:
        factor = np.uint64(power)
        if size & length:
            out = part if out is None else out[: max(0, len(part) - done)] * factor + part[done:]
            done += length
        part = part[: max(0, len(part) - length)] * factor + part[length:]
        length, power = 2 * length, power * power % (1 << 64)
    return mixed(out)


def _least(values: np.ndarray, span: int, least=np.minimum) -> np.ndarray:
    """The least of each ``span`` neighbours."""
    out, length = values, 1
    while 2 * length <= span:
        out, length = least(out[:-length], out[length:]), 2 * length
    return least(out[: len(out) - (span - length)], out[span - length :]) if span > length else out


def anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs that stand for a phrase: their hashes, and the words where they begin. Equal phrases choose equal runs."""
    if len(hashes) < PHRASE:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    runs = run_hashes(hashes, ANCHOR, _BASES[0])
    span = PHRASE - ANCHOR + 1
    edge = np.zeros(span - 1, np.uint64)
    # a run is the least of some phrase just where the largest of the minima around it is its own hash
    largest = _least(np.concatenate([edge, _least(runs, span), edge]), span, np.maximum)
    at = np.flatnonzero(runs == largest)
    return runs[at].view(np.int64), at.astype(np.int32)


def repeated_phrases(hashes: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both hashes and the first word of each phrase whose run is at one of ``spots``."""
    runs = run_hashes(hashes, ANCHOR, _BASES[0])
    span = PHRASE - ANCHOR + 1
    some = np.full(len(runs), np.iinfo(np.uint64).max, np.uint64)
    some[spots] = runs[spots]
    start = np.flatnonzero(_least(some, span) == _least(runs, span))
    one, other = (run_hashes(hashes, PHRASE, base) for base in _BASES)
    return one[start].view(np.int64), (other[start] >> np.uint64(32)).astype(np.uint32).view(np.int32), start.astype(np.int32)


def _words(text: pa.Scalar) -> list[bytes]:
    """Maximal runs of anything but ASCII blanks, as UTF-8: ``bytes.split`` knows no other blanks."""
    return (text.as_py() or "").encode().split()


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), F.xxhash64(F.lit(PHRASE), "text").alias("other"), "text")


def _of(other: DataFrame, *keys: str) -> tuple[DataFrame, Column]:
    """``other`` with its keys renamed, and the condition that they are those of a table; null is a key of its own."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return other.withColumnsRenamed({k: f"_{k}" for k in keys}), condition


def _find_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, runs, at = [], [], []
        for text in batch.column("text"):
            words = _words(text)
            found = anchors(word_hashes(words))
            n.append(len(words))
            runs.append(found[0])
            at.append(found[1])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "hash", "other")), pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))], [c.split()[0] for c in RUNS.split(", ")])


def _index_phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in PHRASES.split(", ")]
    for batch in batches:
        for text, spots, base in zip(batch.column("text"), batch.column("spots"), batch.column("base").to_pylist()):
            h, g, start = repeated_phrases(word_hashes(_words(text)), spots.values.to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(g), pa.array(np.full(len(h), base, np.int64)), pa.array(start)], names)


def parse(start: np.ndarray, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where factors begin among the phrases found (in order), and how many phrases each has: a factor goes on while the next word's phrase is found at the source's next word."""
    first = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (np.diff(source) != 1)])) if len(start) else np.zeros(0, np.int64)
    return first, np.diff(np.append(first, len(start)))


def _parse_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Factors of each document; its phrases come in order, over as many batches as they need."""
    names = [c.split()[0] for c in FACTORS.split(", ")]
    sent = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names)
    held = None  # the open factor: base, start, phrases, source
    for batch in batches:
        base, start, source = (batch.column(c).to_numpy() for c in ("base", "start", "source"))
        rows = []
        borders = np.append(np.flatnonzero(np.concatenate([[True], np.diff(base) != 0])), len(base)) if len(base) else [0]
        for a, b in zip(borders[:-1], borders[1:]):
            for k, n in zip(*parse(start[a:b], source[a:b])):
                new = int(base[a]), int(start[a + k]), int(n), int(source[a + k])
                if held and held[0] == new[0] and held[1] + held[2] == new[1] and held[3] + held[2] == new[3]:
                    held = (*held[:2], held[2] + new[2], held[3])
                    continue
                if held:
                    rows.append((held[0], held[1], held[2] + PHRASE - 1, held[3]))
                held = new
        if rows:
            yield sent(rows)
    if held:
        yield sent([(held[0], held[1], held[2] + PHRASE - 1, held[3])])


def placed(keys: DataFrame) -> DataFrame:
    """``keys`` (doc_id, hash, n_words) with ``base``, the place of a document's first word: running totals within range partitions, and an offset for each."""
    order = F.col("doc_id").asc_nulls_first(), F.col("hash")
    cut = Stored(keys.repartitionByRange(shuffle_partitions(keys.sparkSession), *order).withColumn("part", F.spark_partition_id()), "keys").df
    totals = sorted((r["part"], r["n"]) for r in cut.groupBy("part").agg(F.sum("n_words").alias("n")).collect())  # a row for each partition
    offsets = keys.sparkSession.createDataFrame([(part, sum(n for _, n in totals[:k])) for k, (part, _) in enumerate(totals)], "part int, offset long")
    before = F.sum("n_words").over(Window.partitionBy("part").orderBy(*order)) - F.col("n_words")
    return cut.withColumn("before", before).join(F.broadcast(offsets), "part").select("doc_id", "hash", (F.col("before") + F.col("offset")).alias("base"))


def _copies(keys: DataFrame) -> DataFrame:
    """doc_id, hash and n_words of the documents whose whole text an earlier one has: one factor of ``PHRASE`` words or more."""
    first = Stored(keys.groupBy("hash", "other").agg(F.min(F.struct("doc_id")).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("hash").alias("_hash"), F.col("other").alias("_other"), F.col("first.doc_id").alias("first")), "first")
    same = (F.col("hash") == F.col("_hash")) & (F.col("other") == F.col("_other"))
    return keys.where(F.col("n_words") >= PHRASE).join(first.df, same).where(~F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "hash", "n_words")


def _each_once(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """``docs`` without the repeats of rows that have both doc_id and text in common."""
    if repeats.isEmpty():
        return docs
    repeats, same = _of(repeats, "doc_id", "hash")
    return docs.join(repeats, same, "left_anti").unionByName(docs.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "hash"]))


def factors(docs: DataFrame) -> DataFrame:
    """doc_id, hash (of the text) and spans: first word and number of words of every factor that has an earlier source. Documents without one have no row. Stored."""
    keyed = _keyed(docs)
    found = Stored(keyed.mapInArrow(_find_runs, RUNS), "runs")
    runs = found.df
    counted = Stored(runs.groupBy("doc_id", "hash", "other").agg(F.max("n_words").alias("n_words"), F.count("*").alias("n")), "counted")
    repeats = Stored(counted.df.where("n > 1").select("doc_id", "hash"), "repeats")
    copies = Stored(_copies(counted.df), "copies")
    twice = Stored(runs.select(F.explode("runs").alias("_run")).groupBy("_run").agg(F.count("*").alias("n")).where("n > 1").select("_run"), "twice")
    each = runs.select("doc_id", "hash", F.explode(F.arrays_zip("runs", "at")).alias("r")).select("doc_id", "hash", F.col("r.runs").alias("run"), F.col("r.at").alias("at"))
    spots = each.join(twice.df, F.col("run") == F.col("_run")).groupBy("doc_id", "hash").agg(F.collect_set("at").alias("spots"))
    bases = Stored(placed(counted.df.select("doc_id", "hash", "n_words")), "bases")
    base, same = _of(bases.df, "doc_id", "hash")
    copied, as_copied = _of(copies.df.select("doc_id", "hash"), "doc_id", "hash")
    marked = Stored(spots.join(copied, as_copied, "left_anti").join(base, same).select("doc_id", "hash", "base", "spots"), "spots")
    found.drop()
    release_shuffles(docs.sparkSession)
    spots, same = _of(marked.df, "doc_id", "hash")
    phrases = Stored(_each_once(keyed, repeats.df).join(spots, same).select("text", "spots", "base").mapInArrow(_index_phrases, PHRASES), "phrases")
    place = F.col("base") + F.col("start")
    release_shuffles(docs.sparkSession)
    index = Stored(phrases.df.groupBy("h", "g").agg(F.min(place).alias("source"), F.max(place).alias("last")).where("last > source").select(F.col("h").alias("_h"), F.col("g").alias("_g"), "source"), "index")
    release_shuffles(docs.sparkSession)
    met = phrases.df.join(index.df, (F.col("h") == F.col("_h")) & (F.col("g") == F.col("_g"))).where(place > F.col("source")).select("base", "start", "source")
    parsed = met.repartition("base").sortWithinPartitions("base", "start").mapInArrow(_parse_documents, FACTORS)
    spans = parsed.groupBy("base").agg(F.collect_list(F.struct("start", "length")).alias("spans"))
    base, same = _of(bases.df, "base")
    whole = copies.df.select("doc_id", "hash", F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("length"))).alias("spans"))
    out = Stored(spans.join(base, same).select("doc_id", "hash", "spans").unionByName(whole), "factors").df
    for table in (marked, phrases, index, bases, copies, repeats, twice, counted):
        table.drop()
    release_shuffles(docs.sparkSession)
    return out


def kept_words(words: list[bytes], spans: list[dict]) -> list[bytes]:
    gone = np.zeros(len(words), bool)
    for span in spans:
        gone[span["start"] : span["start"] + span["length"]] = True
    return [w for w, g in zip(words, gone) if not g]


LEFT = "struct<text:string,n_words:bigint,n_removed:bigint>"


def _without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out, n, removed = [], [], []
    for text, own in zip(texts, spans):
        words = _words(text)
        kept = kept_words(words, own.as_py() or [])
        out.append(b" ".join(kept))
        n.append(len(words))
        removed.append(len(words) - len(kept))
    return pa.StructArray.from_arrays([pa.array(out, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(removed, pa.int64())], ["text", "n_words", "n_removed"])


def _deduped(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` as a struct ``d``, so that no name can clash, and ``left``: text (what stays), n_words and n_removed."""
    spans, _ = _of(factors(docs), "doc_id", "hash")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("d"))
    same = F.col("d.doc_id").cast("long").eqNullSafe(F.col("_doc_id")) & (F.xxhash64("d.text") == F.col("_hash"))
    return whole.join(spans, same, "left").select("d", F.arrow_udf(_without, LEFT)("d.text", "spans").alias("left"))


def dedup_passages(docs: DataFrame) -> DataFrame:
    """``docs`` with the words that stay, joined by one blank; a null text stays null. n_chars, where there is one, follows the text."""
    text = F.when(F.col("d.text").isNotNull(), F.col("left.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return _deduped(docs).select(*(new[c].alias(c) if c in new else F.col(f"d.`{c}`").alias(c) for c in docs.columns))


def passage_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the text that stays, its words joined by one blank."""
    return _deduped(docs.select("doc_id", "text")).select(F.col("d.doc_id").cast("long").alias("doc_id"), "left.n_words", "left.n_removed", "left.text")
