"""Every query on odd tables: columns whose names clash with the operators' own, repeated and null rows, and no rows at all."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kgloom.llm import queries

from .test_documents import ODD, prose

CLASHING = ("raw", "found", "w", "part", "row", "fp", "range", "ahead", "gone", "size", "target", "full", "_text", "shard", "rejected", "i", "n", "p", "tie", "of", "_lines", "first")
#: Rows of the result for each document row; packing gives a row for each piece instead.
ROW_FOR_ROW = sorted(set(queries.QUERIES) - {"op10_packing", "op13_conversations"})
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def write(spark, docs, labels, folder):
    docs.write.parquet(str(folder / "documents.parquet"))
    labels.write.parquet(str(folder / "labels.parquet"))
    docs.sparkSession.createDataFrame([], CONVERSATIONS).write.parquet(str(folder / "conversations.parquet"))
    return str(folder)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rows = [(k, t, ("en", "de", None)[n % 3], (None, "a", "b")[n % 3], 0) for n, (k, t) in enumerate(ODD)] + [(100 + k, prose(60), "en", "a", 0) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in CLASHING})
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(100, 130)] + [(None, 0, 1), (101, None, None), (101, 1, 0)], "doc_id long, quality int, toxic int")
    return write(spark, docs, labels, tmp_path_factory.mktemp("odd")), len(rows)


@pytest.mark.parametrize("name", ROW_FOR_ROW)
def test_odd_tables(spark, odd, name):
    folder, n = odd
    assert queries.QUERIES[name](spark, folder).count() == n


def test_odd_tables_are_packed_whole(spark, odd):
    got = queries.QUERIES["op10_packing"](spark, odd[0])
    assert got.where("start = 0").count() == odd[1]


def test_odd_tables_through_the_pipeline(spark, odd):
    docs = spark.read.parquet(f"{odd[0]}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, odd[0])
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() > 20 and corpus_pipeline.STAGES[-1][1](spark, docs, odd[0]).count() >= docs.count()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_rows(spark, tmp_path, name):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    folder = write(spark, docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), tmp_path)
    assert queries.QUERIES[name](spark, folder).count() == 0


def test_no_rows_through_the_pipeline(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
