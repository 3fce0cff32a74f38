"""Documents to packed sequences: language ID, line dedup, SimHash near-dedup, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns the columns of documents (the last: pieces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kgloom.llm import language, line_dedup, mixing, packing, simhash
from kgloom.llm.common import read_table, scratch
from kgloom.shipping import ensure_importable


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go."""
    ensure_importable(spark)
    return language.keep_identified(docs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the later occurrences of three-line windows; n_chars follows the text."""
    return line_dedup.dedup_lines(docs)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group stays."""
    ensure_importable(spark)
    return simhash.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    ensure_importable(spark)
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ensure_importable(spark)
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", remove_repeated_lines),
    ("simhash_near_dedup", remove_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Compression, SimHash, balanced sampling and tokens are beyond SQL: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch() as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
    return docs
